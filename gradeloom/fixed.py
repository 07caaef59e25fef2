"""Fixed values that results depend on: wording, markers, catalogues and limits.

They must not be reworded, since stored prompts and predictions were made with them.
"""

# The letters an option can have, in order.
LETTERS = "abcdefghijklmnopqrstuvwxyz"

# Prompt templates by id; "%s" takes the question body.
TEMPLATES = {
    "0": "Ceci est une question de QCM de l'examen de pharmacie. Réponds avec la ou les lettres "
    "correspondant à la bonne réponse.\n\n%s",
    "en/0": "This is a multiple choice question from the pharma exam. Reply with the letter or the "
    "letters corresponding to the correct answer.\n\n%s\n\nAnswer : (",
}

# The answer cue and the parts around it.
ANSWER_CUE = "\nRéponse(s) :"
MEMORIZATION_CUE = "Complete from (a) to (e).\n\n"
COMPLETION_MARKER = "Réponse(s) :"
ECHOED_INSTRUCTION = "Ceci est une question de QCM.*"

# Option keys shown to the model and held back in the memorization check.
SHOWN_KEYS = "abc"
HELD_OUT_KEYS = "de"

# Patterns of the answer reader.
PARENTHESIZED = r"^[a-z]\)|\([a-z]\)"
BETWEEN_WORDS = r"[^\p{L}\p{N}_]+"
PARAGRAPH_BREAK = r"\n[ \t]*\n"
DEFAULT_LABEL = "a"
DEFAULT_OPTIONS = 5

# The characters Python treats as white space when it strips a string.
WHITE_SPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)

# Chat wording and markers of the model families.
SYSTEM_TEXT = (
    "You are a friendly chatbot who responds accuractly to the user without explaining the answer."
)
PROMPTER_WRAP = ("<|prompter|>", "<|endoftext|><|assistant|>")
INSTRUCTION_END = "[/INST]"
ASSISTANT_MARK = "<|assistant|>"
COMMENT_MARK = "#"

# Hosted models by provider, and whether they are called as chat or as plain completion.
CHAT_MODELS = [
    "gpt-3.5-turbo-0301",
    "gpt-3.5-turbo",
    "gpt-4",
    "gpt-4-0314",
    "gpt-4-32k",
    "gpt-4-32k-0314",
]
CHAT_PROVIDER = "openai"
COMPLETION_PROVIDERS = ["openai", "cohere", "ai21"]

# How each model family is prompted and how its text is cut.
# (profile, wrapper, text mode, left parenthesis, paragraph stop, options assumed, max tokens)
RUNNER_PROFILES = [
    ("api", "user", "none", False, False, None, 32),
    ("bloomz", "plain", "echo", False, False, None, 32),
    ("flan-t5", "plain", "none", False, False, None, 32),
    ("flan-ul2", "plain", "none", False, False, None, 32),
    ("galactica", "plain", "echo", False, False, None, 32),
    ("llama", "plain", "echo_first_line", True, False, 5, 128),
    ("llama2", "plain", "echo", False, False, None, 32),
    ("llama2-finetuned", "plain", "echo", False, True, None, 128),
    ("mistral", "user", "echo_instruction", False, False, None, 32),
    ("mpt", "plain", "echo_comment", False, False, None, 32),
    ("open-assistant", "prompter", "echo", False, False, None, 32),
    ("opt-iml", "plain", "echo", False, False, None, 32),
    ("pmc-llama", "plain", "echo", True, False, None, 32),
    ("tk-instruct", "plain", "none", False, False, None, 32),
    ("zephyr", "system_user", "assistant_line", False, False, None, 32),
]

# Thresholds and sizes.
MEMORIZED_AT = 0.05
REWRITE_BATCH = 20
MAX_TOKENS = 256
# Decoding settings of the memorization check.
MEMORIZATION_SETTINGS = {"max_tokens": "64", "temperature": "0"}

"""Personal data: fixed patterns, and contexts learned from what they find.

E-mail addresses, IP addresses, card and phone numbers found by patterns are the seeds. The words around them are
lexical patterns; a pattern that surrounds mostly known identifiers vouches for what else it surrounds, and what is
vouched for makes other patterns known in the next round. Accepted tokens that no fixed pattern finds are the spans of
kind ``context``. All of it is built-in expressions.
"""

from pyspark.sql import Column, DataFrame, functions as F

from gradeloom.llm.common import apart, stored

KINDS = ("email", "ip", "card", "phone", "context")

#: The patterns in a form that gives the same leftmost matches but never looks at a character often: runs are taken
#: whole, and a match may only begin where a run begins or the last match ended.
EMAIL = (
    r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
)
IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
#: A token without white space that holds a digit.
TOKEN = r"(?<!\S)[^\s0-9]*+[0-9]\S*+"

ROUNDS = 3
LEAST_CONFIDENCE = 0.5
LEAST_SCORE = 0.75
LEAST_LENGTH, LEAST_DIGITS = 7, 4
_CHUNK = 128


def _sum(values: Column, start: Column, length: Column) -> Column:
    return F.aggregate(F.slice(values, start, length), F.lit(0), lambda a, x: a + x)


def located(df: DataFrame, pattern: str, name: str) -> DataFrame:
    """``df`` with an array ``name`` of ``(start, end, found)``: a pattern's matches in ``text``, in code points.

    Starts are the lengths of what stands between and before the matches, summed up in chunks so that the work stays in
    proportion to the number of matches.
    """
    found, gap, step, chunk, n = (f"{name}_{part}" for part in ("found", "gap", "step", "chunk", "n"))
    any_digit = F.col("text").rlike("[0-9@]")
    df = df.withColumn(found, F.when(any_digit, F.regexp_extract_all("text", F.lit(pattern), F.lit(0))))
    df = df.withColumn(n, F.coalesce(F.size(found), F.lit(0)))
    df = df.withColumn(gap, F.when(F.col(n) > 0, F.transform(F.split("text", pattern, -1), F.length)))
    df = df.withColumn(step, F.transform(found, lambda m, i: F.length(m) + F.get(gap, i)))
    chunks = F.sequence(F.lit(0), F.floor((F.col(n) - 1) / _CHUNK).cast("int"))
    sums = F.transform(chunks, lambda c: _sum(F.col(step), c * _CHUNK + 1, F.lit(_CHUNK)))
    df = df.withColumn(chunk, F.when(F.col(n) > 0, sums))

    def place(m, i):
        c = F.floor(i / _CHUNK).cast("int")
        start = _sum(F.col(chunk), F.lit(1), c) + _sum(F.col(step), c * _CHUNK + 1, i % _CHUNK) + F.get(gap, i)
        return F.struct(start.alias("start"), (start + F.length(m)).alias("end"), m.alias("found"))

    empty = F.array().cast("array<struct<start:int,end:int,found:string>>")
    df = df.withColumn(name, F.when(F.col(n) > 0, F.transform(found, place)).otherwise(empty))
    return df.drop(found, gap, step, chunk, n)


def _digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def _luhn(number: Column) -> Column:
    """Whether a string of digits passes: every second digit from the right counts twice, its digits summed."""
    digits = F.transform(F.split(F.reverse(number), "(?!^)(?=.)"), lambda d: d.cast("int"))
    worth = F.transform(digits, lambda d, i: F.when(i % 2 == 0, d).when(d > 4, 2 * d - 9).otherwise(2 * d))
    return F.aggregate(worth, F.lit(0), lambda a, x: a + x) % 10 == 0


def _valid(kind: str, m: Column) -> Column:
    if kind == "ip":
        bare = lambda p: F.regexp_replace(p, "^0+(?=[0-9])", "")
        small = lambda p: (F.length(bare(p)) <= 3) & (F.substring(bare(p), 1, 3).cast("int") <= 255)
        return F.forall(F.split(m, r"\."), small)
    if kind == "card":
        n = _digits(m)
        return F.when(F.length(n).between(14, 19), _luhn(n)).otherwise(F.lit(False))
    if kind == "phone":
        return F.length(_digits(m)).between(10, 15)
    return F.lit(True)


def _checked(kind: str):
    return lambda m: _valid(kind, m["found"])


def _span(kind: str):
    rank = KINDS.index(kind)
    return lambda m: F.struct(m["start"].alias("start"), F.lit(rank).alias("rank"), m["end"].alias("end"))


def joined(spans: Column) -> Column:
    """Spans in order, as ``kind:start:end`` with commas between."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(
        F.transform(F.array_sort(spans), lambda s: F.concat_ws(":", F.get(names, s["rank"]), s["start"], s["end"])), ","
    )


def found_spans(docs: DataFrame) -> DataFrame:
    """``(doc_id, print, spans, tokens)``: each row's base spans, and its tokens with digits in their contexts."""
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")
    )
    for kind, pattern in (("email", EMAIL), ("ip", IP), ("card", CARD), ("phone", PHONE)):
        rows = located(rows, pattern, kind)
        rows = rows.withColumn(kind, F.transform(F.filter(kind, _checked(kind)), _span(kind)))
    rows = rows.withColumn("spans", F.array_sort(F.concat("email", "ip", "card", "phone")))
    rows = located(rows, TOKEN, "token")
    return rows.select(
        "doc_id", F.xxhash64("text").alias("print"), "spans",
        *[F.size(k).cast("long").alias(f"n_{k}") for k in KINDS[:4]],
        F.transform("token", lambda m: _in_context(m)).alias("tokens"),
    )


def _in_context(m: Column) -> Column:
    """A token without the punctuation around it, its place, and the words before and after it."""
    lead = F.length(F.regexp_extract(m["found"], r"^[^\p{L}\p{N}+]*+", 0))
    body = F.regexp_extract(m["found"], r"[\p{L}\p{N}+](?:.*[\p{L}\p{N}])?", 0)
    start = m["start"] + lead
    near = 48
    before = F.substr(F.col("text"), F.greatest(m["start"] - near, F.lit(0)) + 1, F.least(m["start"], F.lit(near)))
    after = F.substr(F.col("text"), m["end"] + 1, F.lit(near))
    word = r"[\p{L}_=:]+"
    left = F.lower(F.regexp_extract(before, rf"({word})[^\p{{L}}_=:]*$", 1))
    right = F.lower(F.regexp_extract(after, rf"^\s+({word})", 1))
    return F.struct(
        start.alias("start"), (start + F.length(body)).alias("end"), body.alias("body"),
        left.alias("left"), right.alias("right"),
    )


def occurrences(spans: DataFrame) -> DataFrame:
    """``(doc_id, print, start, end, body, seed, pattern)``: tokens long enough to identify somebody, by context.

    A token that a base span covers is a seed. Each occurrence has a pattern for the word before and one for the word
    after.
    """
    rows = spans.select("doc_id", "print", "spans", F.explode("tokens").alias("t"))
    overlaps = F.exists("spans", lambda s: (s["start"] < F.col("t.end")) & (F.col("t.start") < s["end"]))
    rows = rows.select("doc_id", "print", "t.*", overlaps.alias("seed"))
    rows = rows.where((F.length("body") >= LEAST_LENGTH) & (F.length(_digits(F.col("body"))) >= LEAST_DIGITS))
    sides = F.array(
        F.when(F.col("left") != "", F.concat(F.lit("< "), "left")),
        F.when(F.col("right") != "", F.concat(F.lit("> "), "right")),
    )
    return rows.select(
        "doc_id", "print", "start", "end", "body", "seed", F.explode(F.array_compact(sides)).alias("pattern")
    )


def bootstrap(found: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """``(body, score)`` of the tokens that contexts vouch for, from ``(body, seed, pattern)`` occurrences.

    The graph has one edge for each pattern and token, whatever their number in the corpus, so copies of a document do
    not vouch for each other. A round gives each pattern the share of its tokens' scores in their number, shrunk by two
    and weighed by how many tokens speak for it, then each token the chance that one of its sure patterns is right.
    """
    edges = stored(found.groupBy("pattern", "body").agg(F.max("seed").alias("seed")), "context-edges")
    scores = edges.groupBy("body").agg(F.max("seed").cast("double").alias("score"))
    for number in range(rounds):
        scored = edges.join(scores.select("body", "score"), "body")
        vouched = F.sum("score")
        confidence = vouched / (F.count("*") + 2) * F.least(F.lit(1.0), F.log2(vouched + 1) / 3)
        sure = scored.groupBy("pattern").agg(confidence.alias("confidence")).where(F.col("confidence") >= LEAST_CONFIDENCE)
        unsure = F.when(F.col("confidence").isNotNull(), F.log1p(-F.least(F.col("confidence"), F.lit(0.999))))
        doubt = F.exp(F.sum(unsure))
        again = edges.join(sure, "pattern", "left").groupBy("body").agg(
            F.max("seed").alias("seed"), (1 - F.coalesce(doubt, F.lit(1.0))).alias("chance")
        )
        scores = stored(
            again.select("body", F.when(F.col("seed"), F.lit(1.0)).otherwise(F.round("chance", 9)).alias("score"), "seed"),
            f"context-scores-{number}",
        )
    return scores.where((F.col("score") >= LEAST_SCORE) & ~F.col("seed")).select("body", "score")


def all_spans(docs: DataFrame) -> DataFrame:
    """``(doc_id, print, n_email, n_ip, n_card, n_phone, spans, context)`` for every row of ``docs``.

    ``spans`` are the base spans and ``context`` those that only contexts vouch for, as arrays of ``(start, rank, end)``.
    Rows are told apart by id and text; equal rows have equal spans. Texts are read once; what is shuffled are tokens
    with digits.
    """
    spans = stored(found_spans(docs), "spans")
    found = stored(occurrences(spans), "occurrences")
    accepted = bootstrap(found)
    more = found.where(~F.col("seed")).join(accepted.select("body"), "body").select("doc_id", "print", "start", "end")
    span = F.struct("start", F.lit(KINDS.index("context")).alias("rank"), "end")
    more = more.groupBy(F.col("doc_id").alias("m_doc"), F.col("print").alias("m_print")).agg(
        F.sort_array(F.collect_set(span)).alias("context")
    )
    rows = spans.drop("tokens").join(
        more, F.col("doc_id").eqNullSafe(F.col("m_doc")) & (F.col("print") == F.col("m_print")), "left"
    )
    return rows.withColumn("context", F.coalesce("context", F.filter("spans", lambda s: F.lit(False)))).drop("m_doc", "m_print")


def personal_data(docs: DataFrame) -> DataFrame:
    """Counts and spans of every whole text: base kinds, their checksum, and all spans with those of the contexts.

    A null text is empty and has none.
    """
    rows = all_spans(docs)
    return rows.select(
        "doc_id", *[f"n_{k}" for k in KINDS[:4]], F.sha2(joined(F.col("spans")), 256).alias("base_sha256"),
        joined(F.concat("spans", "context")).alias("spans"), F.size("context").cast("long").alias("n_context"),
    )


def masked(docs: DataFrame) -> DataFrame:
    """``docs`` with each span of a text replaced by its kind in angle brackets; other columns as they are.

    Spans that overlap are replaced together, by the kind of the first. A null text stays null. Texts without a span do not
    move.
    """
    free = lambda n: n if n not in docs.columns else free(f"{n}_")
    spans, doc, mark = free("pii_spans"), free("pii_doc"), free("pii_print")
    found = all_spans(docs).select(
        F.col("doc_id").alias(doc), F.col("print").alias(mark), F.array_sort(F.concat("spans", "context")).alias(spans)
    )
    found = stored(found.where(F.size(spans) > 0).dropDuplicates([doc, mark]), "spans-to-mask")
    some, clean = apart(docs, F.xxhash64(F.coalesce(F.col("text"), F.lit(""))), found, mark)
    text = some["text"]
    rows = some.join(
        found, some["doc_id"].cast("long").eqNullSafe(found[doc]) & (F.xxhash64(F.coalesce(text, F.lit(""))) == found[mark]), "left"
    )
    names = F.array(*[F.lit(f"<{k.upper()}>") for k in KINDS])
    start = F.struct(F.lit("").alias("out"), F.lit(0).alias("at"))

    def step(acc, s):
        clear = F.concat(acc["out"], F.substr(F.col("text"), acc["at"] + 1, s["start"] - acc["at"]), F.get(names, s["rank"]))
        return F.struct(
            F.when(s["start"] >= acc["at"], clear).otherwise(acc["out"]).alias("out"),
            F.greatest(acc["at"], s["end"]).alias("at"),
        )

    end = lambda acc: F.concat(acc["out"], F.substr(F.col("text"), acc["at"] + 1, F.length("text")))
    changed = F.when(F.col(spans).isNull(), text).otherwise(F.aggregate(spans, start, step, end))
    return rows.select(*[changed.alias("text") if c == "text" else some[c] for c in docs.columns]).unionByName(clean)

"""Row types of the question sets, predictions and results."""

from pyspark.sql import types as T

MCQ = T.StructType(
    [
        T.StructField("id", T.StringType()),
        T.StructField("question", T.StringType()),
        T.StructField("answers", T.MapType(T.StringType(), T.StringType())),
        T.StructField("correct_answers", T.ArrayType(T.StringType())),
    ]
)

MELD = T.StructType(
    [
        T.StructField("prompt", T.StringType()),
        T.StructField("reference", T.StringType()),
        T.StructField("generated", T.StringType()),
        T.StructField("distance", T.DoubleType()),
    ]
)

MELD_RESULT = T.StructType(
    MCQ.fields
    + [
        T.StructField("saved_answers", T.MapType(T.StringType(), T.StringType())),
        T.StructField("meld", MELD),
    ]
)

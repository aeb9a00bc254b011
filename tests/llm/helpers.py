from pyspark.sql import types as T

#: Columns with the names of outputs and of inner columns of the operators.
CLASH = ["n_lines", "kept", "_row", "fp", "component_id", "ids", "score", "h1", "_k", "_gone", "_leak", "kept_text", "fail_bits", "key", "th"]


def documents(spark, rows, clash=True):
    """(doc_id, text) rows as documents with columns of clashing names."""
    names = CLASH if clash else []
    schema = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), *(T.StructField(n, T.StringType()) for n in names)])
    return spark.createDataFrame([(*r, *(f"{n}{i}" if i % 2 else None for n in names)) for i, r in enumerate(rows)], schema)


def words(rng, n, letters="abcdefgh"):
    return " ".join("".join(rng.choice(letters) for _ in range(rng.randint(2, 7))) for _ in range(n))

"""Functions for SQL texts: spark.sql("select corp_name_norm(name) ...") after register(spark)."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from . import text as T


def register(spark: SparkSession) -> list[str]:
    """Registers nfkc (an Arrow UDF), SQL functions over it and over plain expressions, and the table function json_nodes; returns the names."""
    from ..sources.succession import NODES, JsonNodes

    spark.udf.register("nfkc", F.pandas_udf(T._nfkc, "string"))
    bare = "regexp_replace(nfkc(name), '[ 　]', '')"
    for word in T.CORPORATE_WORDS:
        bare = f"replace({bare}, '{word}', '')"
    plain = {
        "corp_name_norm(name string) returns string": bare,
        "is_corporate_number(number string) returns boolean": "coalesce(number rlike '^[0-9]{13}$', false)",
        "looks_like_organ(name string) returns boolean": f"name rlike '^.+(?:{T.ORGAN_ENDINGS})$' or name in ({', '.join(repr(w) for w in T.ORGAN_WORDS)})",
        "iri_quote(part string) returns string": "replace(replace(replace(url_encode(part), '+', '%20'), '*', '%2A'), '%7E', '~')",
    }
    for signature, body in plain.items():
        spark.sql(f"create or replace temporary function {signature} return {body}")
    spark.udtf.register("json_nodes", F.udtf(JsonNodes, returnType=NODES))
    return ["nfkc", *(s.split("(")[0] for s in plain), "json_nodes"]

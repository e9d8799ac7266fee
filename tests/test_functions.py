from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from ledgerweave.functions import iri
from ledgerweave.functions import text as T


def column(spark, values, f, kind="string"):
    frame = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r["r"] for r in frame.select("i", f(F.col("v")).alias("r")).orderBy("i").collect()]


def test_amounts(spark):
    assert column(spark, [" 1,234　", "１２３", "50617000.0", "", "  ", None, "0", "-5"], T.amount) == [1234, 123, 50617000, None, None, None, 0, -5]


@pytest.mark.parametrize("wrong", ["1.5", "abc", "1.0.0"])
def test_other_amounts_raise(spark, wrong):
    with pytest.raises(Exception, match="not an amount"):
        column(spark, [wrong], T.amount)


def test_strip_takes_all_white_space(spark):
    assert column(spark, [" \t　x y  ", "", " "], T.strip) == ["x y", "", ""]


def test_corporate_names(spark):
    assert column(spark, ["㈱ＡＢ", "株式会社　甲 乙", "甲乙(有)", None], T.corporate_name) == ["AB", "甲乙", "甲乙", None]


def test_ministries_of_law_numbers(spark):
    cases = {
        "昭和二十六年大蔵省令第十号": ("found", ["大蔵省"]),
        "平成十二年総理府・大蔵省令第三号": ("found", ["総理府", "大蔵省"]),
        "令和元年政令第五号": ("none", None),
        "人事院規則一〇―七": ("found", ["人事院"]),
        "昭和二十四年人事院規則一": ("found", ["人事院"]),
        "規則第一号": ("failed", None),
        "平成十五年運輸委令第一号": ("failed", None),
        "令和三年法律第八号": ("none", None),
        "大正三年逓信省令第四号の二": ("found", ["逓信省"]),
    }
    got = column(spark, list(cases), T.ministries_of)
    assert [(r["status"], r["names"]) for r in got] == list(cases.values())


def test_notes(spark):
    assert column(spark, ["甲法（乙） ", "甲法(乙)", "（甲）法"], T.without_wide_note) == ["甲法", "甲法(乙)", "（甲）法"]
    assert column(spark, ["甲（乙）", "甲(乙)", "甲"], T.without_note) == ["甲", "甲", "甲"]


def test_truth_raises_on_other_words(spark):
    assert column(spark, ["true", "1", "false", "0"], T.truth) == [True, True, False, False]
    with pytest.raises(Exception, match="not a boolean"):
        column(spark, ["yes"], T.truth)


def test_display_of_amounts(spark):
    values = [1_250_000_000_000, 123_456_000_000, 150_000_000, 12_345, 999, -20_000, 0]
    assert column(spark, values, T.rounded_amount, "bigint") == ["1.3兆円", "1,235億円", "1.5億円", "1万円", "999円", "-2万円", "0円"]
    assert column(spark, values[:1], T.full_amount, "bigint") == ["1,250,000,000,000円"]


def test_quoting_matches_the_url_rules(spark):
    from urllib.parse import quote

    cases = ["a b", "~x*y", "省/令", "(甲)", "A-_.9"]
    assert column(spark, cases, iri.quote) == [quote(c, safe="") for c in cases]


def test_addresses(spark):
    assert column(spark, ["1234567890123"], iri.organization) == [f"{iri.BASE}/id/org/1234567890123"]
    with pytest.raises(Exception, match="corporate number"):
        column(spark, ["123"], iri.organization)
    with pytest.raises(Exception, match="empty part"):
        column(spark, [""], iri.law)
    dated = column(spark, ["x 1", None, ""], lambda c: iri.law_revision(F.lit("L"), F.lit("2024-03-01").cast("date"), c))
    assert dated == [f"{iri.BASE}/id/law/L/20240301_x%201", f"{iri.BASE}/id/law/L/20240301", f"{iri.BASE}/id/law/L/20240301"]
    assert column(spark, ["a/b#c", "a/b/c"], iri.local_name) == ["c", "c"]


def test_content_digest_ignores_line_ends(spark):
    a, b = column(spark, ["x\r\ny\r\n", "x\ny\n"], T.content_digest)
    assert a == b


def test_registered_for_sql(spark, sf_dir):
    from ledgerweave.functions.register import register
    from ledgerweave.plans.harness import Harness

    assert "json_nodes" in register(spark)
    row = spark.sql("select corp_name_norm('㈱ ＡＢ') as a, iri_quote('a b*~') as b, looks_like_organ('財務省') as c, is_corporate_number('1') as d").first()
    assert tuple(row) == ("AB", "a%20b%2A~", True, False)
    names = Harness(spark, sf_dir).views()
    assert "budget" not in names and spark.sql("select count(*) from project p join organ o on p.ministry = o.corp_no").first()[0] > 0


def test_whole_texts_are_quoted(spark, sf_dir):
    import hashlib
    from urllib.parse import quote

    import __spark_entry__ as entry

    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    found = {r["doc_id"]: r["quoted_sha256"] for r in entry.queries()["quoted_whole_texts"](spark, sf_dir).collect()}
    assert found == {i: hashlib.sha256(quote(t, safe="").encode()).hexdigest() for i, t in texts.items()}

import random
import re

import pytest
from docloom.functions import dates, text
from docloom.functions.text import MARKERS
from pyspark.sql import functions as F


def one(spark, values, column, schema="a string, b string"):
    rows = [v if isinstance(v, tuple) else (v, None) for v in values]
    return [r[0] for r in spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], f"i long, {schema}").orderBy("i").select(column).collect()]


def test_tokens(spark):
    got = one(spark, ["Суд и ДЕЛО о взыскании, 12 a bb", "", None, "Ёж еж"], text.tokens(F.col("a")))
    assert got == [["взыскании", "12", "bb"], [], [], ["ёж", "еж"]]


def test_tokens_with_lemmas(spark):
    lemma = F.create_map(F.lit("взыскании"), F.lit("взыскание"), F.lit("судов"), F.lit("суд"))
    assert one(spark, ["взыскании судов долга"], text.tokens(F.col("a"), lemma=lemma)) == [["взыскание", "долга"]]


def test_norm_tag(spark):
    assert one(spark, ["Исковая_ давность", "src-1", "- _"], text.norm_tag(F.col("a"))) == ["исковаядавность", "src1", ""]


def brute_sections(t):
    out = {"fabula": "", "lower_courts": "", "vs_position": "", "residual": ""}
    hits = sorted((m.start(), m.end(), s) for s, ms in MARKERS.items() for p in ms for m in re.finditer(p + r"[:\s]*", t, re.I))
    if not hits:
        return {**out, "residual": t}
    for k, (_, end, s) in enumerate(hits):
        chunk = t[end : hits[k + 1][0] if k + 1 < len(hits) else len(t)].strip()
        out[s] = out[s] + "\n" + chunk if out[s] else chunk
    if hits[0][0]:
        out["residual"] = t[: hits[0][0]].strip()
    return out


def test_sections_against_brute_force(spark):
    rnd = random.Random(3)
    bits = ["Фабула дела: ", "обстоятельства ДЕЛА", "Судебные акты:\n", "Позиция нижестоящих суда ", "Позиция ВС:", "Верховный суд указала ", "СКЭС указал\n", "Выводы Верховного Суда: ", "текст ", "ещё слово. ", "\n", " "]
    texts = ["".join(rnd.choice(bits) for _ in range(rnd.randint(0, 9))) for _ in range(300)] + ["  без меток  ", ""]
    got = one(spark, texts, text.sections(F.col("a")))
    assert [r.asDict() for r in got] == [brute_sections(t) for t in texts]


def test_case_ids(spark):
    rows = [("305-ЭС23-29227", "см. А40-96313/2021 и 5-КГ22-300, А40-96313/2021"), ("305 эс 23 292 27", ""), (None, None), ("А 40-1 / 2020; 305-ЭС24-11", "305-ЭС24-11")]
    got = one(spark, rows, text.case_ids(F.col("a"), F.col("b")))
    assert got[0] == ["305-ЭС23-29227", "А40-96313/2021", "5-КГ22-300"]
    assert got[1] == ["305-ЭС23-292"]
    assert got[2] == []
    assert got[3] == ["305-ЭС24-11", "А40-1/2020"]


def test_snippet(spark):
    def brute(v, r, t):
        b = next((x for x in (v, r, t) if x), "").strip().replace("\n", " ")
        if len(b) <= 250:
            return b
        dot = b[:250].rfind(".")
        return b[: dot + 1] if dot > 125 else b[:250] + "..."

    rnd = random.Random(5)
    rows = [("".join(rnd.choice(["слово ", "а. ", "\n", "bb"]) for _ in range(rnd.randint(0, 140))), rnd.choice(["", "остаток."])) for _ in range(200)]
    rows += [("x" * 125 + "." + "y" * 200, ""), ("x" * 126 + "." + "y" * 200, "")]
    got = one(spark, rows, text.snippet(F.col("a"), F.col("b"), F.lit("title")))
    assert got == [brute(a, b, "title") for a, b in rows]


def test_small_functions(spark):
    assert one(spark, ["#a, ##b ; ,c"], text.clean_hashtags(text.split_csv(F.col("a")))) == [["a", "b", "c"]]
    assert one(spark, ["канал «Новости ВС РФ»", " прочее "], text.channel(F.col("a"))) == ["Новости ВС РФ", "прочее"]
    assert one(spark, ["a\n\n\n\nb"], text.collapse_lines(F.col("a"))) == ["a\n\nb"]
    assert one(spark, ["ст. 33 и 196"], text.digit_runs(F.col("a"))) == [["33", "196"]]
    assert one(spark, ["  A  b "], text.query_key(F.col("a"))) == one(spark, ["a b"], text.query_key(F.col("a")))


def test_dates(spark):
    assert one(spark, ["1.2.2024", "31.02.2020", "05.11.2023 г.", "", None, "2024-01-01"], dates.iso_date(F.col("a"))) == ["2024-02-01", "", "2023-11-05", "", "", ""]
    assert one(spark, ["305-ЭС24-1", "5-КГ98-3", "225-УД24-1-А6", "АПЛ22", "А40-1/2021", "А40-1/1901", ""], dates.year_from_case(F.col("a"))) == [2024, 1998, 2024, 2022, 2021, None, None]
    assert one(spark, ["Определение от 5.6.2023 и", "Определение от 5.6.1999", "Постановление от 5.6.2023", "x" * 800 + "Определение от 5.6.2023"], dates.year_from_anchor(F.col("a"))) == [2023, None, None, None]


def test_reconcile(spark):
    def brute(d, a, c):
        ok = [y for y in (a, d) if y is not None and (c is None or y >= c)]
        return max(ok) if ok else c

    vals = [None, 2018, 2020, 2022, 2024]
    rows = [(d, a, c) for d in vals for a in vals for c in vals]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, d int, a int, c int").orderBy("i")
    assert [r[0] for r in df.select(dates.reconcile(F.col("d"), F.col("a"), F.col("c"))).collect()] == [brute(*r) for r in rows]


def test_freshness(spark):
    got = spark.createDataFrame([(2026,), (2022,), (None,), (0,), (2030,)], "y int").select(dates.freshness(F.col("y"))).collect()
    assert [round(r[0], 6) for r in got] == [1.3, pytest.approx(1.110364), 1.0, 1.0, 1.3]

"""Names matched by pattern, against trying every pattern on every name."""

import random
import re

import pytest

from scenaria.operators.joins import ambiguous_names, pattern_matches, xwalk_pattern_to_code

PATTERNS = [
    (r"\bkorea\b", r"\b(north|dem|dpr|people)", "KOR", ["korea"]), (r"\bkorea\b.*\b(dem|people)|\bnorth korea\b", None, "PRK", ["korea"]),
    (r"\bbolivia\b", None, "BOL", ["bolivia"]), (r"^(united kingdom|great britain)", None, "GBR", ["united", "kingdom"]),
    (r"\bcongo\b", r"\bdem", "COG", ["congo"]), (r"\bdem.*\bcongo\b|\bcongo.*\bdem", None, "COD", ["congo"]),
    (r"\bguinea\b", r"new|equator|bissau", "GIN", ["guinea"]), (r"\bpapua\b", None, "PNG", ["papua", "guinea"]), (r"\bnew guinea\b", None, "NGU", ["new", "guinea"]),
]
NAMES = ["Korea, Rep.", "Korea, Dem. People's Rep.", "Bolivia (Plurinational State of)", "  United   KINGDOM ", "Congo", "Congo, Dem. Rep.", "Guinea",
         "Guinea-Bissau", "Papua New Guinea", "Atlantis", "", None, "Koreana"]
SCHEMA = "pattern string, unless string, code string, words array<string>"


def brute(names, patterns):
    out = {}
    for n in names:
        if n is not None:
            s = re.sub(r"\s+", " ", n).strip().lower()
            codes = {c for p, u, c, w in patterns if re.search(p, s) and not (u and re.search(u, s))
                     and all(x in re.split(r"[^\w]+", s) for x in w)}
            if codes:
                out[s] = sorted(codes)
    return out


@pytest.fixture(scope="module")
def table(spark):
    return spark.createDataFrame(PATTERNS, SCHEMA)


def test_country_names(spark, table):
    df = spark.createDataFrame([(n, i) for i, n in enumerate(NAMES)] + [("Guinea", 99)] * 3, "country string, row int")
    got = {r.row: (r.country_code, r.codes) for r in xwalk_pattern_to_code(df, "country", table, candidates="codes").collect()}
    assert [got[i][0] for i in range(len(NAMES))] == ["KOR", "PRK", "BOL", "GBR", "COG", "COD", "GIN", None, None, None, None, None, None]
    assert got[8][1] == ["NGU", "PNG"] and got[99][0] == "GIN"
    assert [tuple(r) for r in ambiguous_names(df, "country", table).collect()] == [("papua new guinea", ["NGU", "PNG"])]
    assert xwalk_pattern_to_code(df, "country", table).count() == len(NAMES) + 3


def test_against_every_pattern_on_every_name(spark, table):
    rng = random.Random(4)
    words = ["korea", "north", "dem", "rep", "new", "guinea", "papua", "congo", "bolivia", "united", "kingdom", "people", "bissau", "x"]
    names = [" ".join(rng.choice(words) for _ in range(rng.randrange(1, 5))) for _ in range(400)]
    got = {r["name"]: list(r.codes) for r in pattern_matches(spark.createDataFrame([(n,) for n in names], "n string"), "n", table).collect()}
    assert got == brute(names, PATTERNS) and any(len(v) > 1 for v in got.values())


def test_empty_tables_and_patterns_without_words(spark, table):
    df = spark.createDataFrame([("Korea",)], "n string")
    assert pattern_matches(df.limit(0), "n", table).collect() == []
    assert xwalk_pattern_to_code(df, "n", table.limit(0)).first().country_code is None
    with pytest.raises(Exception, match="without words"):
        pattern_matches(df, "n", spark.createDataFrame([("korea", None, "KOR", [])], SCHEMA)).collect()

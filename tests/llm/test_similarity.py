import hashlib
import random

import numpy as np
import pytest
from llm_fixtures import DOCS, brute_components, edited, frame, odd, shingle_set, words

from scenaria.llm.common import components
from scenaria.llm.minhash import fingerprints, near_groups
from scenaria.llm.parity_join import bands, jaccard_components, most_apart, one_of_each


@pytest.fixture(scope="module")
def near(spark):
    rng = random.Random(3)
    base, short = words(rng, 150, 10**6), words(rng, 12, 10**6)
    texts = [" ".join(edited(rng, base, rng.choice([0, 0.005, 0.01, 0.02, 0.05]))) for _ in range(90)]
    texts += [" ".join(edited(rng, short, 0.06)) for _ in range(20)]
    texts += [" ".join(words(rng, rng.randrange(1, 40), 30)) for _ in range(60)]
    texts += [texts[0]] * 12 + [t.upper() for t in texts[:6]] + ["a b c d e f g h i j k", "a b c d e f g h i j k l", "", "x"]
    rng.shuffle(texts)
    return texts, frame(spark, texts)


@pytest.mark.parametrize("width,percent", [(3, 90), (5, 80)])
def test_components_equal_brute_force(near, width, percent):
    texts, df = near
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_components(df, percent, width).collect()}
    assert got == brute_components(list(range(len(texts))), texts, width, percent)


def test_each_band_has_more_blocks_than_differences():
    for percent in (50, 80, 90, 95):
        seen = 0
        for low, high, blocks in bands(percent, 5000):
            assert blocks > most_apart(2 * high, percent)
            assert seen in (0, low - 1) and low <= high
            seen = high


def test_one_of_each_keeps_the_smallest(near):
    texts, df = near
    expected = {c for _, c in brute_components(list(range(len(texts))), texts, 5, 80).values()}
    out = one_of_each(df, 80, 5)
    assert {r.doc_id for r in out.collect()} == expected
    assert out.columns == df.columns


def test_odd_rows(spark):
    df = odd(spark)
    got = jaccard_components(df).collect()
    assert len(got) == df.count()
    assert {(r.doc_id, r.component_id) for r in got} >= {(0, 0), (1, 1), (4, 4), (5, 4), (6, 6), (None, None), (3, 3)}
    kept = one_of_each(df)
    assert kept.columns == df.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(["0", "1", "2", "3", "4", "6", "7", "8", "None", "None"])
    assert jaccard_components(df.limit(0)).collect() == []
    assert one_of_each(df.limit(0)).collect() == []


def test_near_groups_find_the_links(near):
    texts, df = near
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_groups(df, 80).collect()}
    assert got == brute_components(list(range(len(texts))), texts, 5, 80)


def test_fingerprints_against_texts(spark):
    rng = random.Random(8)
    texts = [" ".join(words(rng, rng.randrange(0, 300), 10**5)) for _ in range(60)] + ["", "é" * 9, "a  b\nc d e f"]
    df = frame(spark, texts, [3 * i for i in range(len(texts))]).repartition(5)
    got = {r.doc_id: r for r in fingerprints(df).collect()}
    assert len(got) == len(texts)
    error = []
    for i, t in enumerate(texts):
        m, after = len(t) // 4, texts[(i + 1) % len(texts)]
        new = t[:len(t) - m] + after[:m]
        r = got[3 * i]
        assert (r.n_chars, r.edited_sha256) == (len(t), hashlib.sha256(new.encode()).hexdigest())
        a, b, c = shingle_set(t, 5), shingle_set(new, 5), shingle_set(after, 5)
        error += [r.near_edited - (len(a & b) / len(a | b) if a | b else 1), r.near_next - (len(a & c) / len(a | c) if a | c else 1)]
    assert abs(np.mean(error)) < 0.02 and np.max(np.abs(error)) < 0.25
    # the fingerprint of an edited text is the one that text gets as a document
    again = frame(spark, [texts[5][:len(texts[5]) - len(texts[5]) // 4] + texts[6][:len(texts[5]) // 4], "z"], [1, 2])
    assert got[15].edited_fingerprint == fingerprints(again).where("doc_id = 1").first().fingerprint


def test_fingerprints_of_odd_rows(spark):
    df = odd(spark)
    got = fingerprints(df).collect()
    assert len(got) == df.count()
    same = [r.fingerprint for r in got if r.doc_id in (4, 5)]
    assert same[0] == same[1]
    assert fingerprints(df.limit(0)).collect() == []
    alone = fingerprints(frame(spark, ["a b c d e f g h"])).first()
    assert alone.near_next == 1.0


def test_connected_components_of_chains(spark):
    edges = [(i, i + 1) for i in range(200, 260)] + [(5, 900), (900, 17), (3, 3)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(got[i] == 200 for i in range(200, 261)) and got[900] == got[17] == 5

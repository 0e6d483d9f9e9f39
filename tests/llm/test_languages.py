import os

import pytest
from pyspark.sql import functions as F

from punctum.llm.languages import Classifier, LanguageParams, cheapest, main_language, named_language, passages, segments, with_segments
from tests.oracle import DATA

pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
P = LanguageParams()


@pytest.fixture(scope="module")
def samples(spark):
    out = {}
    for r in spark.read.parquet(f"{DATA}/lang_samples.parquet").orderBy("line_no").collect():
        out.setdefault(r["lang"], []).append(r["text"])
    return out


def test_held_out_lines(samples):
    c = Classifier({k: v[::2] for k, v in samples.items()}, P)
    right = total = 0
    for lang, lines in samples.items():
        for i in range(1, len(lines), 2):
            sizes = c.sizes(lines[i])
            right += c.codes[min(range(len(sizes)), key=sizes.__getitem__)] == lang
            total += 1
    assert right / total > 0.97


def test_mixed_text_and_what_is_no_passage(samples):
    c = Classifier(samples, P)
    de, ru, zh = " ".join(samples["de"][:3]), " ".join(samples["ru"][:2]), "".join(samples["zh"][:2])
    text = f"# Short summary\n\n{de}\n\n| x | y |\n|---|---|\n\n- {ru}\n> {zh}\n```\nprint(len(out))\n```\nKlup4, Wurk18, Jourk10, Breip8, Mund, Skein, Geil, Thalb, Coun, Mack\n— “nearest neighbour search”"
    got = segments(text, c)
    assert [s[2] for s in got if s[4] >= P.passage] == ["de", "ru", "zh"]
    assert all(0 < s[3] <= 1 for s in got)
    assert segments(de.upper().replace("Ä", "A"), c)[0][2] == "de"


@pytest.mark.parametrize("text", [None, "", " \n ", "42", "a\tb\tc\n1\t2\t3", "```\nx = 1\n```", "🧠🔬 ✅", "Mund, Skein, Geil, Coun"])
def test_texts_in_no_language(samples, text):
    assert segments(text, Classifier(samples, P)) == []


def test_very_long_text(samples):
    c = Classifier(samples, P)
    got = segments(" ".join(samples["fr"]) * 60 + "\n" + "x" * 50_000, c)
    assert got[0][2] == "fr" and got[0][4] > 10_000


def test_price_of_a_change():
    assert cheapest([[10, 20], [20, 12], [10, 20]], 10) == [0, 0, 0]
    assert cheapest([[10, 40], [60, 12], [10, 40]], 10) == [0, 1, 0]
    assert cheapest([], 10) == []


def test_labels(spark):
    names = {"en": "en", " EN ": "en", "en_GB": "en", "zh-Hans-CN": "zh", "zho": "zh", "中文": "zh", "Français": "fr", "\tdeutsch\xa0": "de", "dut": "nl", "ger-AT": "de", "und": None, "mul": None, "": None, "-": None, "english!": None, "xx": None, "englisch": None, None: None}
    df = spark.createDataFrame([(k, v) for k, v in names.items()], "label string, want string")
    assert df.where(~named_language(F.col("label")).eqNullSafe(F.col("want"))).collect() == []


def test_tables(spark, samples):
    de, ru = " ".join(samples["de"][:3]), " ".join(samples["ru"][:3])
    docs = spark.createDataFrame([(1, de, "k"), (2, None, "k"), (3, f"{de}\n\n{ru} {ru}", "k"), (3, f"{de}\n\n{ru} {ru}", "k"), (4, "", None)], "doc_id long, text string, lang string")
    lines = spark.read.parquet(f"{DATA}/lang_samples.parquet")
    s = with_segments(docs, lines)
    assert sorted(map(tuple, passages(s).collect())) == [(1, "de"), (3, "de"), (3, "ru")]
    top = {r["doc_id"]: r["lang"] for r in main_language(s).collect()}
    assert top == {1: "de", 2: None, 3: "ru", 4: None}
    assert with_segments(docs.limit(0), lines).count() == 0
    assert passages(with_segments(docs, lines.limit(0))).count() == 0


def test_every_dictionary_is_tried_whatever_the_script(samples):
    from punctum.llm.languages import plain

    c = Classifier(samples, P)
    for lang in c.codes:
        text = plain(samples[lang][0])
        assert c.sizes(text) == [sum(len(compress[i](wide(text))) for wide, compress in c.codings) for i in range(len(c.codes))]

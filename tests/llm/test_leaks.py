import random
import re

import pytest

from punctum.llm import leaks
from punctum.llm.leaks import ItemBlock, compare, item_blocks, leaked_items, opening, passage_words, vocabulary
from punctum.llm.words import words

ASK = "Read the passage and then answer the question that follows it. "
NOUNS = "lamp reel vial gauge prism resin valve needle drawer bench tracer ledger shutter paste colony magnet".split()
VERBS = "measured folded packed warped lifted nudged cooled etched drained rotated".split()


def passage(i):
    rng = random.Random(i)
    out = []
    for _ in range(4):
        a, b, c = rng.sample(NOUNS, 3)
        out.append(f"When the {a} {rng.choice(VERBS)} a {b}, Zor{'abcdefghij'[i % 10]}n{rng.choice('xyz')} {rng.choice(VERBS)} the {c} and {rng.choice(VERBS)} {rng.randint(2, 99)} {rng.choice(NOUNS)}s.")
    return " ".join(out)


ITEMS = [(i, (ASK if i % 2 else "") + passage(i)) for i in range(12)]
ORDINARY = vocabulary([p for _, p in ITEMS])
WORDS = [passage_words(p, p.startswith(ASK)) for _, p in ITEMS]


def found(spark, texts, items=ITEMS):
    d = spark.createDataFrame([(i, t, "x", 7) for i, t in enumerate(texts)], "doc_id long, text string, item_id string, h1 int")
    e = spark.createDataFrame([(i, p, "y") for i, p in items], "item_id long, passage string, text string")
    return {(r["doc_id"], r["item_id"]): (r["held"], r["varied"]) for r in leaked_items(d, e).collect()}


def test_forms_of_a_passage(spark):
    w = WORDS[1]
    noise = "nothing of that kind is written in this note about the left half of the section"
    edited = list(w[:15])
    for k in (2, 7, 12):
        edited[k] = "other"
    too_many = list(edited)
    too_many[5] = "fourth"
    texts = [
        f"{noise} {' '.join(w[:15])} {noise}",
        f"{noise} {' '.join(w[:11])} {noise}",
        f"{noise} {' '.join(edited)} {noise}",
        f"{noise} {' '.join(too_many)} {noise}",
        " ".join(w[:30]).upper(),
        "\n> ".join(f"<b>{x}</b>" if k % 3 else f"*{x}*" for k, x in enumerate(w[:40])),
        " ".join(x[:2] + "­" + x[2:] for x in w[:20]),
        " ".join(w[:20]).replace("e", "é").replace("a", "а"),
        " ".join(random.Random(1).sample(w, len(w))),
        ASK * 3,
        None,
        "",
        " \n ",
    ]
    got = found(spark, texts)
    held = {d for (d, i), (h, _) in got.items() if h and i == 1}
    assert held == {0, 2, 4, 5, 6, 7}
    assert not [k for k, v in got.items() if v[0] and k[1] != 1]


def test_broken_words():
    assert words("measu-\r\n> red the gra​nular la­mp&#44; Kim's ﬂask") == "measured the granular lamp kims flask".split()
    assert words(None) == words(" ") == []


def slotted(i, names, numbers):
    rng = random.Random(i)
    pick = lambda: rng.choice(NOUNS)
    return " ".join(f"the {pick()} {rng.choice(names)} {rng.choice(VERBS)} under {rng.choice(numbers)}" for _ in range(9))


def test_planted_questions_with_other_slots_are_told_from_held_ones(spark):
    items = [(i, slotted(i, ["Zorban", "Xilut", "Prask"], [12, 35, 78])) for i in range(4)]
    swap = {"Zorban": "Mekun", "Xilut": "Dorra", "Prask": "Vint", "12": "13", "35": "64", "78": "90"}
    other = [" ".join(swap.get(w, w) for w in p.split()) for _, p in items]
    for k, t in enumerate(other):  # every second name also changes within one text: no mapping fits
        names = iter([f"Um{chr(97 + n)}k" for n in range(26)])
        other[k] = t if k < 3 else " ".join(next(names) if w[0].isupper() or w.isdigit() else w for w in t.split())
    texts = [f"note {t} end" for t in other] + [f"note {p} end" for _, p in items]
    got = found(spark, texts, items)
    assert [got.get((i, i)) for i in range(3)] == [(False, True)] * 3 and not got.get((3, 3), (False, False))[0]
    assert [got.get((i + 4, i)) for i in range(4)] == [(True, False)] * 4


def test_rows_come_through_templates_and_slots(monkeypatch):
    block = ItemBlock([i for i, _ in ITEMS], [p for _, p in ITEMS], WORDS)
    text = " ".join(WORDS[2][:20])
    assert [r[0] for r in block.found(text)] == [2]
    monkeypatch.setattr(leaks, "template", lambda ws, ordinary: ["<name>"] + [f"t{k}" for k in range(len(ws) - 1)] if ws is WORDS[2] else ["no"] * len(ws))
    assert block.found(text) == []


def test_any_number_of_items_comes_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(leaks, "BLOCK", 100)
    e = spark.createDataFrame([*ITEMS, (99, None)] * 2, "item_id long, passage string")
    blocks = list(item_blocks(e))
    assert len(blocks) > 3 and sorted(i for b in blocks for i in b.ids) == [*range(12), 99]
    assert {i: w for b in blocks for i, w in zip(b.ids, b.words)}[1] == WORDS[1]
    assert opening(ITEMS[1][1]) == " ".join(words(ASK))
    got = found(spark, [ITEMS[i][1] for i in (3, 4)])
    assert {k for k, (h, _) in got.items() if h} == {(0, 3), (1, 4)}


def test_slots_one_for_one():
    item, ordinary = "aa bb Xim cc dd Xim ee ff 12 gg hh Yol ii jj kk ll mm Yol nn".split(), frozenset("aa bb cc dd ee ff gg hh ii jj kk ll mm nn".split())
    low = [w.lower() for w in item]
    swap = {"xim": "rud", "yol": "vep", "12": "31"}
    assert compare(low, [swap.get(w, w) for w in low], ordinary) == (False, True)
    clash = [swap.get(w, w) for w in low]
    clash[5], clash[17] = "vep", "nob"
    assert compare(low, clash, ordinary) == (False, False)


def test_copies_long_texts_and_no_items(spark):
    w = " ".join(WORDS[3][:25])
    filler = " ".join(random.Random(2).choice(NOUNS) for _ in range(30_000))
    long = f"{filler} {w} {filler}"
    got = found(spark, [w, w, long, "x" * 100_000])
    assert {d for (d, i), (h, _) in got.items() if h and i == 3} == {0, 1, 2}
    assert found(spark, [w], []) == {}
    assert found(spark, []) == {}
    assert found(spark, [w], [(1, None), (2, ""), (3, "too short")]) == {}


@pytest.mark.parametrize("seed", range(25))
def test_alignment_against_plain_edit_distance(seed):
    from punctum.llm.leaks import _codes, holds_stretch

    rng = random.Random(seed)
    p = [rng.choice("abcdef") for _ in range(rng.randint(10, 24))]
    t = list(p)
    for _ in range(rng.randint(0, 7)):
        k = rng.randrange(len(t))
        if rng.random() < 0.4:
            t[k] = "z"
        elif rng.random() < 0.5:
            del t[k]
        else:
            t.insert(k, "y")
    t = [rng.choice("abc") for _ in range(3)] + t

    def edits(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            last, row[0] = row[0], i
            for j, y in enumerate(b, 1):
                last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
        return row[-1]

    want = any(edits(p[a:b], t[c:d]) <= (b - a) // 5 for a in range(len(p)) for b in range(a + 15, len(p) + 1) for c in range(len(t) + 1) for d in range(max(c, c + (b - a) - 5), min(len(t), c + (b - a) + 5) + 1))
    assert holds_stretch(*_codes(p, t)) == want


def test_tags_of_any_length_are_markup():
    assert words(f'left <span title="{"x " * 400}">granular</span> lamp') == ["left", "granular", "lamp"]

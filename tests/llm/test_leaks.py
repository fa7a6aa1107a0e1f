"""Decontamination on single forms of re-parameterised items."""

import random

import pytest

from tracklane.llm import decontaminate

ITEM = "Tom has 5 apples and buys 7 more at the old market. Tom then gives 3 of them to Anna. How many does he still keep in the basket?"
AROUND = "Some words stand before it here. {} And a few other words stand behind it there."


def held(spark, texts, items):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    return {(r.doc_id, r.item_id) for r in decontaminate.find_leaks(docs, bench).collect()}


@pytest.mark.parametrize(
    "item, doc",
    [
        (ITEM, ITEM.replace("Tom", "Jane").replace("5", "6")),
        (ITEM, ITEM.replace("Tom", "Jane Doe").replace("Anna", "Bo Li")),
        (ITEM.replace("Tom", "Tom Smith"), ITEM.replace("Tom", "Jane")),
        (ITEM, ITEM.replace("Tom", "Élan").replace("Anna", "Østen")),
        ("the rope is 5km long and weighs 12kg when it is wet", "the rope is 8 km long and weighs 30 kg when it is wet"),
        ("there are fourteen boats and sixty sails on the lake today", "there are 9 boats and twenty-five sails on the lake today"),
        ("What is 12 + 7?", "What is 30 + 4?"),
        ("How old is Anna?", "How old is Peter?"),
        ("the old market square", "The old market square"),
    ],
)
def test_item_is_found(spark, item, doc):
    assert held(spark, [doc, AROUND.format(doc), "nothing of the kind is said in these words"], [item]) == {(0, 0), (1, 0)}


def test_short_item_without_a_word_needs_its_values(spark):
    assert held(spark, ["he paid 42 and left", "he paid 43 and left"], ["42", "?"]) == {(0, 0)}


def test_tables_of_numbers_tell_nothing(spark):
    """Windows of placeholders alone are not counted, on either side."""
    item = "the sums of 1 2 3 4 5 6 7 8 9 10 11 12 are asked for here by the teacher"
    doc = "the sums of 4 7 1 9 3 8 2 6 5 0 13 14 are asked for here by the teacher"
    numbers = " ".join(str(k) for k in range(3000))
    assert held(spark, [doc, numbers, f"{numbers} apples {numbers}", "1 2 3 4 5 6"], [item, "1 2 3 4 5 6 7"]) == {(0, 0)}


FAR = "the first boat carries 5 crates from the harbour to the island every day while the second one that sails later carries 5 crates and the third carries 9 of them"


@pytest.mark.parametrize(
    "doc, leak",
    [
        (FAR.replace("5", "6").replace("9", "2"), True),
        (FAR.replace("5", "6", 1), False),  # one value becomes two, more than a window apart
        (FAR.replace("9", "5"), False),  # two values become one
        (FAR.replace("while", "and so on, while"), True),
    ],
)
def test_values_agree_over_the_item(spark, doc, leak):
    assert held(spark, [AROUND.format(doc)], [FAR]) == ({(0, 0)} if leak else set())


def test_scattered_windows_are_no_leak(spark):
    words = FAR.split()
    apart = [" ".join(words[i : i + 9]) for i in range(0, len(words), 5)]
    filler = " and here is something quite unlike all that was said before it "
    assert held(spark, [filler.join(apart), filler.join(reversed(apart)), " ".join(apart[::-1])], [FAR]) == set()


def test_plain_version(spark):
    """Random texts of few words and numbers: an item without gaps in the document, by every alignment."""
    rng = random.Random(3)
    items = [" ".join(rng.choice(("red", "blue", "tea", "1", "2", "3")) for _ in range(12)) for _ in range(8)]
    docs = []
    for _ in range(60):
        own = rng.choice(items).split()
        mapping = dict(zip("123", rng.sample("123456", 3) if rng.random() < 0.7 else rng.choices("12", k=3), strict=True))
        docs.append(" ".join(["green"] * rng.randint(0, 5) + [mapping.get(w, w) for w in own] + ["green"]))
    want = set()
    for d, doc in enumerate(docs):
        w = doc.split()
        for i, item in enumerate(items):
            v = item.split()
            for a in range(len(w) - len(v) + 1):
                both = list(zip(v, w[a : a + len(v)], strict=True))
                pairs = {(x, y) for x, y in both if x.isdigit() and y.isdigit()}
                if all(x == y or (x.isdigit() and y.isdigit()) for x, y in both) and len(pairs) == len(dict(pairs)) == len({y for _, y in pairs}):
                    want.add((d, i))
    got = held(spark, docs, items)
    assert want and len(want) < 60 and got == want

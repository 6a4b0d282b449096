from trackspark.llm import decontamination as d

from .conftest import rows_of

ITEM = " ".join(f"q{i}" for i in range(20))
ITEMS = [(1, ITEM), (2, "Short ITEM, here"), (3, None), (4, "?!"), (5, ITEM.upper()), (6, "naïve Ünit")]
DOCS = [
    (1, "before. " + ITEM.replace(" ", ", ") + " after"), (2, "a short item; here and more " * 3), (3, None), (4, ""), (5, "... !!"), (6, " ".join(ITEM.split()[:12])),
    (7, " ".join(["filler"] * 400) + " " + " ".join(ITEM.split()[:13])), (8, "x" + ITEM + "x " + ITEM), (9, "NAÏVE naïve Ünit"), (9, "NAÏVE naïve Ünit"), (10, "word " * 5000 + ITEM),
]


def bench(spark, items=ITEMS):
    return spark.createDataFrame(items, "item_id long, text string")


def expected():
    out = [(i, *(r := d.brute(t, ITEMS)).values()) for i, t in DOCS]
    assert r
    return sorted(out, key=repr)


def test_against_brute_force(spark, docs):
    assert rows_of(d.report(docs(*DOCS), bench(spark)), "doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated") == expected()


def test_in_blocks(spark, docs, monkeypatch):
    monkeypatch.setattr(d, "BLOCK_WINDOWS", 3)
    assert rows_of(d.report(docs(*DOCS), bench(spark)), "doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated") == expected()


def test_spans_point_into_the_original(spark, docs):
    rows = d.decontaminate(docs(*DOCS), bench(spark), with_text=True).where("doc_id in (1, 9)").collect()
    cut = {r.doc_id: [r.text[s.start : s.end] for s in r.decon.spans] for r in rows}
    assert cut[1] == [ITEM.replace(" ", ", ")] and cut[9] == ["naïve Ünit"]


def test_blocks_give_the_spans_of_one_automaton(spark, docs, monkeypatch):
    side = " ".join(f"r{i}" for i in range(13))
    texts = [*DOCS, (11, f"Before {ITEM}, {side}; after. {side}"), (12, "é" * 9 + " " + side)]
    items = [*ITEMS, (7, side), (8, f"q19 {side}")]
    whole = rows_of(d.report(docs(*texts), bench(spark, items)), "doc_id", "n_hit", "n_items", "spans")
    assert (11, 46, 4, f"7-{len(ITEM) + len(side) + 9},{len(ITEM) + len(side) + 18}-{len(ITEM) + 2 * len(side) + 18}") in whole
    monkeypatch.setattr(d, "BLOCK_WINDOWS", 3)
    source = docs(*texts)
    assert rows_of(d.report(source, bench(spark, items)), "doc_id", "n_hit", "n_items", "spans") == whole
    assert d.decontaminate(source, bench(spark, items), with_text=True).columns == [*source.columns, "decon"]


def test_clean_keeps_columns_and_clean_documents(spark, docs):
    source = docs(*DOCS)
    kept = d.clean(source, bench(spark))
    assert kept.columns == source.columns
    assert {r.doc_id for r in kept.collect()} == {3, 4, 5, 6, 7, 10}
    assert d.report(source, bench(spark).limit(0)).where("contaminated or n_hit > 0").count() == 0
    assert d.report(source.limit(0), bench(spark)).count() == 0

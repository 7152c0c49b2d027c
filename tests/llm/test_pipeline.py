import corpus_pipeline as cp
from mirrorplan.llm.queries import vocabulary
from tests.llm.test_decontaminate import words
from tests.llm.test_lines import brute as brute_lines
from tests.llm.test_packing import check
from tests.llm.test_nearcopies import plain_components

SF = "/root/testdata/sf0.001"


def test_each_stage_against_a_plain_one(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, kept = docs.columns, []
    for k, (_, stage) in enumerate(cp.STAGES):
        stage(spark, docs, SF).write.parquet(f"{tmp_path}/{k}")
        before, docs = docs, spark.read.parquet(f"{tmp_path}/{k}")
        kept.append((before.collect(), docs.collect()))
        if k < 4:
            assert docs.columns == columns
    (raw, good), (_, lined), (_, single), (_, clean), (_, packed) = kept
    assert 0.7 * len(raw) < len(good) <= len(raw)
    want = brute_lines([(r.doc_id, r.text) for r in good], 16)
    assert {r.doc_id: r.text for r in lined} == {i: t for i, t in want.items() if t.strip()}
    assert all(r.n_chars == len(r.text) for r in lined)
    groups = plain_components([(r.doc_id, r.text) for r in lined])
    assert {r.doc_id for r in single} == {c for _, c in groups}
    items = [words(r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    wins = {tuple(w[k : k + 10]) for w in items for k in range(len(w) - 9)}
    hit = lambda t: any(tuple(words(t)[k : k + 10]) in wins for k in range(len(words(t)) - 9))
    left = {r.doc_id: r.text for r in clean}
    assert any(hit(r.text) for r in single) and not any(hit(t) for t in left.values())
    assert all(left[r.doc_id] == r.text for r in single if not hit(r.text))
    assert check([(r.doc_id, r.text) for r in clean], packed) < 2 * 2048 + 0.02 * sum(r.length for r in packed) and vocabulary()


def test_quality_stage_rejects_bad_documents(spark):
    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    kept = {r.doc_id for r in cp.quality_stage(spark, docs, sf).collect()}
    marks = spark.read.parquet(f"{sf}/labels.parquet").collect()
    assert sum(r.doc_id in kept for r in marks if r.quality == 1) > 0.97 * sum(r.quality == 1 for r in marks)
    assert sum(r.doc_id in kept for r in marks if r.quality == 0) < 0.4 * sum(r.quality == 0 for r in marks)


def test_run(spark):
    assert cp.run(spark, SF).count() > 0


def test_stages_on_edges_of_input(spark):
    """Nulls, blanks, repeated rows and clashing names: no stage fails, columns stay, and each case has its defined result."""
    prose = "Plain words of a document that someone wrote, long enough to be a line of its own."
    rows = [(1, None), (2, ""), (3, " \n"), (4, prose), (4, prose), (5, prose), (None, prose), (None, None), (6, "a b"), (6, "c d e f"), (7, "x " * 4000)]
    clash = ("'k' as key", "'f' as fp", "1 as did", "'h' as hits", "2 as size", "'s' as lead", "true as component")
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").selectExpr("*", "cast(0 as int) as n_chars", *clash)
    kept = {}
    for name, stage in cp.STAGES[:4]:
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns, name
        kept[name] = sorted(((r.doc_id, r.text) for r in out.collect()), key=str)
        assert stage(spark, docs.limit(0), SF).collect() == [], name
    assert {(None, None), (1, None), (2, ""), (3, " \n"), (None, prose)} <= set(kept["line dedup"]) and (5, prose) not in kept["line dedup"]
    near = kept["near-duplicates"]
    assert [i for i, _ in near if i is not None] == [1, 4, 6, 7] and near.count((4, prose)) == 1 and (6, "a b") in near
    assert (None, prose) in near and (None, None) in near
    assert kept["benchmark decontamination"] == sorted(rows, key=str)
    packed = cp.packing_stage(spark, docs, SF).collect()
    assert sum(r.length for r in packed if r.doc_id == 1) == 1 and sum(r.length for r in packed) > len(rows)
    assert cp.packing_stage(spark, docs.limit(0), SF).collect() == []

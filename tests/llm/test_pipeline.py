import public_tokenizers
import pytest
import sentencepiece

import corpus_pipeline
from tallyfield.llm import jaccard, leaks, rules
from tallyfield.llm.secrets import RULES, Scanner

FOLDER = "/root/testdata/sf0.001"


def test_stages_are_named_in_order():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "jaccard_join", "decontamination", "secret_scan", "sentencepiece"]


def test_each_stage_against_its_own_input(spark, tmp_path):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    seen = [docs]
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, seen[-1], FOLDER)
        if k < 4:
            assert out.columns == docs.columns
        out.write.parquet(str(tmp_path / name))
        seen.append(spark.read.parquet(str(tmp_path / name)))
    rows = [{r.doc_id: r for r in df.collect()} for df in seen]
    labels = spark.read.parquet(f"{FOLDER}/labels.parquet")
    kept = {r.doc_id for r in rules.judge(docs, rules.fit_rules(docs, labels)).collect() if r.kept}
    assert set(rows[1]) == kept
    groups = {r.doc_id: r.component_id for r in jaccard.similar_groups(seen[1]).collect()}
    assert set(rows[2]) == {i for i, c in groups.items() if i == c}
    leaked = {r.doc_id for r in leaks.leaked_items(seen[2], spark.read.parquet(f"{FOLDER}/benchmark.parquet")).collect()}
    assert set(rows[3]) == set(rows[2]) - leaked
    scan = Scanner(RULES)
    assert set(rows[4]) == set(rows[3])
    for i, r in rows[4].items():
        spans = scan.spans(rows[3][i].text.encode())
        assert (r.text == rows[3][i].text) == (not spans) and not scan.spans(r.text.encode())
    library = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    assert {i: r.ids for i, r in rows[5].items()} == {i: library.encode(r.text) for i, r in rows[4].items()}


def test_run_equals_the_stages(spark):
    got = corpus_pipeline.run(spark, FOLDER)
    assert got.columns == ["doc_id", "n_tokens", "ids"]
    assert all(r.n_tokens == len(r.ids) for r in got.collect())


@pytest.mark.parametrize("name", [f"op{n}_" for n in range(1, 14)])
def test_every_operator_has_one_query(name):
    from tallyfield.llm.queries import QUERIES

    assert sum(q.startswith(name) for q in QUERIES) == 1


def test_queries_cover_their_tables(spark):
    from tallyfield.llm.queries import QUERIES

    size = {t: spark.read.parquet(f"{FOLDER}/{t}.parquet").count() for t in ("documents", "pages", "benchmark")}
    for name, run in QUERIES.items():
        rows = run(spark, FOLDER).count()
        if name.startswith("op10"):
            assert rows > 0
        elif name.startswith("op13"):
            assert 10 * size["benchmark"] < rows <= 20 * size["benchmark"]
        else:
            assert rows == size["pages" if name.startswith(("op6", "op12")) else "documents"], name


def test_last_stage_decodes_its_ids(spark):
    texts = ["The  cat sat.", "", None, "Zażółć \u4f60\u597d \U0001f600 tail", " lead\nand\tbreak "]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    library = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    rows = corpus_pipeline.sentencepiece(spark, docs, FOLDER).collect()
    assert {r.doc_id: r.decoded for r in rows} == {i: library.decode(library.encode(t or "")) for i, t in enumerate(texts)}

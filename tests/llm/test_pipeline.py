"""The stages, each on all that its predecessor kept."""

import re

import corpus_pipeline
from framelake.llm import bpe, jaccard, secrets, toxicity


def test_stages(spark, sf_dir, tmp_path):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns, seen = docs.columns, {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, sf_dir)
        out.write.parquet(str(tmp_path / name))
        seen[name] = (docs, spark.read.parquet(str(tmp_path / name)))
        docs = seen[name][1]
        assert k == 4 or docs.columns == columns
    before, after = seen["near_duplicates"]
    assert after.count() == jaccard.near_duplicates(before).select("group_id").distinct().count()
    assert after.count() == after.select("doc_id").distinct().count()
    before, after = seen["secrets"]
    assert after.count() == before.count()
    assert not [r for r in after.collect() if any(k < 2 for _, k, _ in secrets.base_spans(r.text or ""))]
    words = lambda df: sum(len(re.findall(r"[^\x20\x09-\x0D]+", r.text)) for r in df.collect())
    before, after = seen["mixing"]
    assert abs(words(after) - 1.5 * words(before)) < 25
    before, after = seen["encoding"]
    assert after.count() == before.count()
    encoder = bpe.Encoder(bpe.load(bpe.vocabulary_path()))
    assert sum(r.n_tokens for r in after.collect()) == sum(len(encoder.encode(r.text)) // 4 for r in before.collect())
    before, after = seen["toxicity"]
    weights = toxicity.learn(before, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    assert after.count() == before.count() - toxicity.score(before, weights).where("predicted = 1").count()


SCHEMA = "doc_id long, text string, lang string, source string, n_chars int, toxic string, shard string, _id string"


def hard_documents():
    prose = " ".join(f"word{k * 7 % 41}" for k in range(90))
    near = prose.replace("word7 ", "other ", 1)
    key = "Zk3q9XvB7tLpQ2mWnR8s5yDfGh1JcV4e"
    texts = [prose, prose, near, None, "", "  ", f"see {key} and password = hunter2hunter2", "x" * 30_000, "one", f"{prose} {key}", *[f"text number {k} of its own " * 3 for k in range(20)]]
    rows = [(k, t, "en", None if k % 5 == 0 else f"s{k % 2}", None if t is None else len(t), "a", "b", "c") for k, t in enumerate(texts)]
    rows += [(None, t, None, "s0", None, None, None, None) for t in ("nobody's text, of its own", prose + " more", "nobody's text, of its own", None)]
    return rows + [(3, "the id of another text", "en", "s1", 22, "a", "b", "c"), rows[12], rows[12]]


def test_stages_on_hard_documents(spark, sf_dir, tmp_path):
    rows = hard_documents()
    docs = spark.createDataFrame(rows, SCHEMA).repartition(3)
    seen = []
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, sf_dir).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        assert k == 4 or (docs.columns == [x.split(" ")[0] for x in SCHEMA.split(", ")] and docs.dtypes == spark.createDataFrame([], SCHEMA).dtypes)
        seen.append(docs.collect())
    toxic, near, clean, mix, tokens = seen
    plain = lambda r: (r.doc_id, r.text, r.source, r.n_chars)
    assert {plain(r) for r in near} <= {plain(r) for r in toxic} <= {(r[0], r[1], r[3], r[4]) for r in rows}
    assert len([r for r in near if r.text and r.text.startswith("word0 ")]) == 1 or toxicity.THRESHOLD <= 0  # the copies, and the near ones, are one group
    assert len([r for r in near if r.doc_id is None]) >= 1 and len([r for r in near if not (r.text or "").strip()]) == 1
    assert len(clean) == len(near) and not [r for r in clean if "Zk3q9XvB7t" in (r.text or "") or "hunter2hunter2" in (r.text or "")]
    kept = {(r.doc_id, r.text) for r in clean}
    assert {(r.doc_id, r.text) for r in mix} <= kept and len(tokens) == len(mix)
    assert sorted(str(r.doc_id) for r in tokens) == sorted(str(r.doc_id) for r in mix)


def test_stages_on_an_empty_table(spark, sf_dir):
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, spark.createDataFrame([], SCHEMA), sf_dir).count() == 0, name


def test_run_is_the_stages_in_order(spark, sf_dir):
    out = corpus_pipeline.run(spark, sf_dir)
    assert out.columns[:2] == ["doc_id", "n_tokens"] and out.count() > 0
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "near_duplicates", "secrets", "mixing", "encoding"]

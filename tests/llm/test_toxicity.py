import random
import zlib

from llm_cases import DOCS, awkward, make, prose, rows  # noqa: F401

from shelfwise.llm import toxicity as T


def corpus(n):
    rng = random.Random(5)
    docs, labels = [], []
    for i in range(n):
        sentences = [" ".join(prose(1000 * i + s, rng.randint(3, 12))) for s in range(rng.randint(1, 8))]
        toxic = rng.random() < 0.3
        if toxic:
            at = rng.randrange(len(sentences))
            sentences[at] += f" {rng.choice(['nastyword', 'vilething'])}{rng.choice(['s', 'ed', 'er', ''])}"
        docs.append((i, ". ".join(sentences) + "."))
        labels.append((i, int(toxic)))
    return docs, labels


def test_learns_from_documents_and_locates_sentences(make, spark):
    docs, labels = corpus(600)
    known = spark.createDataFrame([(i, 1, t) for i, t in labels if zlib.crc32(str(i).encode()) % 4 != 2] + [(None, 1, 1), (7, 1, None), (10_000, 0, 1)], "doc_id long, quality int, toxic int")
    model = T.train(make(docs), known)
    got = {r.doc_id: r for r in T.score(make(docs), model).collect()}
    test = [(i, t) for i, t in labels if zlib.crc32(str(i).encode()) % 4 == 2]
    right = sum((got[i].toxicity >= T.THRESHOLD) == bool(t) for i, t in test)
    assert right >= 0.95 * len(test)
    toxic = [got[i] for i, t in labels if t]
    assert sum("nastyword" in r.worst_sentence or "vilething" in r.worst_sentence for r in toxic) >= 0.95 * len(toxic)
    assert "source" in got[0] and got[0].source == "s"
    again = T.train(make(docs[::-1]), known)
    assert abs(again.bias - model.bias) < 1e-6


def test_awkward_rows_and_labels_of_one_kind(make, spark, awkward):
    labels = spark.createDataFrame([(6, 0), (7, 0)], "doc_id long, toxic int")
    model = T.train(make(awkward), labels)
    got = T.score(make(awkward), model).collect()
    assert len(got) == len(awkward) and all(0 <= r.toxicity <= 1 for r in got)
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert T.train(make(awkward), none).prior == 0
    assert T.score(make([]), model).count() == 0


def test_held_out_rule(spark):
    got = spark.range(200).withColumnRenamed("id", "doc_id").select("doc_id", T.held_out().alias("h")).collect()
    assert all(r.h == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in got)


def test_query(spark, tmp_path):
    docs, labels = corpus(200)
    spark.createDataFrame(rows([*docs, (None, "x"), (500, None)]), DOCS).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 1, t) for i, t in labels], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    got = T.op3_toxicity(spark, str(tmp_path)).collect()
    assert len(got) == 202 and all(r.predicted == (r.score >= 0.3) and r.held_out is not None for r in got)

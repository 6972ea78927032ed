"""The stages on a small corpus, each against a plain version."""

import zlib

import numpy as np
import pytest

public_tokenizers = pytest.importorskip("public_tokenizers")

import corpus_pipeline  # noqa: E402
from monthmark.llm.mixing import mix_sources  # noqa: E402
from monthmark.llm.token_binary import encoder  # noqa: E402
from monthmark.llm.toxicity import score_toxicity  # noqa: E402
from tests.llm.helpers import docs_of, edited, prose, shingles, similarity  # noqa: E402
from tests.llm.test_decontaminate import best_window  # noqa: E402
from tests.llm.test_near_dedup import brute  # noqa: E402
from tests.llm.test_toxicity import text  # noqa: E402


def test_stages(spark, tmp_path):
    rows = [(i, text(i, i % 3 == 0), f"s{i % 3}") for i in range(90)]
    rows += [(200 + i, prose(i, 80), "s1") for i in range(20)] + [(300 + i, edited(prose(i, 80), i, 0.01), None) for i in range(8)]
    rows += [(400 + i, prose(700 + i, 30) + " " + prose(600, 40), "s2") for i in range(3)] + [(500, None, "s1"), (501, "", None)]
    docs_of(spark, rows, clashes=False).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 1, int(i % 3 == 0)) for i in range(90)], "doc_id long, quality int, toxic int").write.parquet(
        f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, prose(600, 40))], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["toxicity", "near_dedup", "decontamination", "mixing", "token_output"]
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    columns = docs.columns
    frames = [docs]
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, frames[-1], str(tmp_path))
        out.write.parquet(f"{tmp_path}/out{k}")
        frames.append(spark.read.parquet(f"{tmp_path}/out{k}"))
        if k < 4:
            assert frames[-1].columns == columns
    held = [[(r["doc_id"], r["text"]) for r in f.select("doc_id", "text").collect()] for f in frames[:5]]
    labels = spark.read.parquet(f"{tmp_path}/labels.parquet")
    bad = {r["doc_id"] for r in score_toxicity(docs, labels).where("predicted = 1").collect()}
    assert bad and sorted(k for k, _ in held[1]) == sorted(r[0] for r in rows if r[0] not in bad)
    groups = brute(held[1])
    assert sorted(held[2], key=str) == sorted(((k, t) for k, t in held[1] if groups[k] == k), key=str)
    assert len(held[2]) < len(held[1])
    clean = [(k, t) for k, t in held[2] if best_window(t, prose(600, 40)) < 0.8]
    assert sorted(held[3], key=str) == sorted(clean, key=str) and len(clean) < len(held[2])
    copies = {r["doc_id"]: r["copies"] for r in mix_sources(frames[3]).collect()}
    assert sorted(held[4], key=str) == sorted(((k, t) for k, t in held[3] for _ in range(copies[k])), key=str)
    library = encoder(public_tokenizers.path("byte_bpe_50k.json")).library
    want = sorted((k, zlib.crc32(np.array(library.encode(t or "", add_special_tokens=False).ids + [2], "<u4").tobytes())) for k, t in held[4])
    assert sorted((r["doc_id"], r["ids_crc32"]) for r in frames[5].collect()) == want
    assert similarity(shingles("a b"), shingles("a b")) == 1


def test_registered():
    import __spark_entry__ as entry

    names = [n for n in entry.queries() if n.startswith("op")]
    assert [int(n[2:].split("_")[0]) for n in names] == list(range(1, 14)) and "pipeline" in entry.queries()

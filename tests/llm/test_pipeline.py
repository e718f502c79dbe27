"""The whole pipeline against a plain version of its stages."""

import itertools
import random
import zlib

import numpy as np
import pytest

pytest.importorskip("public_tokenizers")
import public_tokenizers as P  # noqa: E402

import corpus_pipeline  # noqa: E402
from evispan.llm import bagminhash, toxicity  # noqa: E402

R = random.Random(11)
WORDS = ["".join(R.choice("abcdeinorst") for _ in range(R.randint(3, 9))) for _ in range(400)]
FOUL = ["vilgrak", "morduk", "snerflog"]


def words(n, more=()):
    return [R.choice(WORDS) for _ in range(n)] + [w for w in more for _ in range(4)]


def tables(spark, folder):
    passage, texts, toxic = " ".join(words(40)), [], set()
    for _ in range(60):
        texts.append(" ".join(words(R.randint(30, 160))))
    for i in range(0, 60, 6):  # near copies, exact copies, a passage that many share
        w = texts[i].split()
        w[R.randrange(len(w))] = "changed"
        texts += [" ".join(w), texts[i], " ".join(words(30)) + " " + passage + " " + " ".join(words(20))]
    for _ in range(90):
        toxic.add(len(texts))
        own = words(60, FOUL)
        R.shuffle(own)
        texts.append(" ".join(own))
    rows = [(i, t, "en", "s", len(t)) for i, t in enumerate(texts)]
    rows += [(len(rows), None, None, None, None), (len(rows) + 1, "", "en", "s", 0), (len(rows) + 2, " ".join(words(5000)), "en", "s", 1)]
    kind = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame(rows, kind).repartition(3).write.parquet(f"{folder}/documents.parquet")
    marks = [(i, 1, int(i in toxic)) for i in range(len(texts))]
    spark.createDataFrame(marks, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return rows, toxic


def near_groups(docs):
    bag, up = bagminhash.Shingler(5), {i: i for i, _ in docs}
    bags = {i: bag(t or "") for i, t in docs}

    def root(x):
        return x if up[x] == x else root(up[x])

    for a, b in itertools.combinations(sorted(bags), 2):
        if bagminhash.overlap(bags[a], bags[b]) >= 0.8:
            x, y = sorted((root(a), root(b)))
            up[y] = x
    return {root(i) for i in bags}


def without_repeats(docs):
    seen, out = set(), {}
    for i, t in sorted(docs):
        raw = (t or "").encode()
        gone = np.zeros(len(raw), bool)
        for a in range(len(raw) - 99):
            w = raw[a : a + 100]
            if w in seen:
                gone[a : a + 100] = True
            seen.add(w)
        left = np.frombuffer(raw, np.uint8)[~gone].tobytes().decode("utf-8", "ignore")
        if left or not gone.any():
            out[i] = left
    return out


def test_pipeline_against_plain_stages(spark, tmp_path):
    from tokenizers import Tokenizer

    folder = str(tmp_path)
    rows, toxic = tables(spark, folder)
    got = [r.asDict() for r in corpus_pipeline.run(spark, folder).collect()]
    scored = {r["doc_id"]: r["predicted"] for r in toxicity.score(spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet")).collect()}
    assert {i for i, p in scored.items() if p} == toxic
    kept = [(i, t) for i, t, *_ in rows if not scored[i]]
    classes = near_groups(kept)
    left = without_repeats([(i, t) for i, t in kept if i in classes])
    tok, want = Tokenizer.from_file(P.path("word_bpe_49k.json")), set()
    for i, t in left.items():
        ids = tok.encode(t, add_special_tokens=False).ids + [1]
        want |= {(i, k, a, len(ids[a : a + 4096]), zlib.crc32(np.array(ids[a : a + 4096], "<u4").tobytes())) for k, a in enumerate(range(0, len(ids), 4096))}
    assert {(r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got} == want and len(got) == len(want)
    by: dict = {}
    for r in got:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for own in by.values():
        own.sort()
        assert [o for o, _ in own] == [sum(n for _, n in own[:j]) for j in range(len(own))] and sum(n for _, n in own) <= 4096
    assert len(by) <= -(-sum(r["length"] for r in got) // 4096) + 1


def test_pipeline_on_empty_tables(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0

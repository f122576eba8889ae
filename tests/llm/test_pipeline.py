"""The pipeline's rows against brute force: every stage after the learned one in plain Python or SQL, on what the one before kept."""

import re
from hashlib import sha256

import duckdb
import public_tokenizers as P
import pyarrow as pa
import pyarrow.parquet as pq
import tiktoken

import corpus_pipeline
from tallyline.llm.byte_bpe import load_ranks
from tallyline.llm.queries import QUERIES, SQL
from tests.llm.test_whole_tables import FOLDER, brute_components, shingles

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def test_pipeline_is_brute_force(spark):
    table = pq.read_table(f"{FOLDER}/documents.parquet")
    toxic = {r["doc_id"] for r in QUERIES["op1_toxicity"](spark, FOLDER).filter("predicted = 1").collect()}
    clean = [r for r in table.to_pylist() if r["doc_id"] not in toxic]
    assert toxic and clean

    best = {}
    for r in clean:
        text = r["text"] or ""
        content = re.sub(r"[\x20\x09-\x0D]", "", text)
        best[content] = min(best.get(content, (1, 0, None)), (-len(text), r["doc_id"], r), key=lambda x: x[:2])
    unique = [r for _, _, r in best.values()]
    assert len(unique) < len(clean)

    component = brute_components({r["doc_id"]: shingles(r["text"] or "") for r in unique})
    apart = [r for r in unique if component[r["doc_id"]] == r["doc_id"]]
    assert len(apart) < len(unique)

    con = duckdb.connect()
    con.register("documents", pa.Table.from_pylist(apart, schema=table.schema))
    taken = {i: (n, size) for i, n, size in con.execute(f"SELECT doc_id, taken, size FROM ({SQL['op9_mixing']})").fetchall()}
    library = tiktoken.Encoding("t", pat_str=P.PATTERN, mergeable_ranks=load_ranks(P.path("byte_bpe_multi_50k.tiktoken")), special_tokens={})
    want = []
    for r in apart:
        left, size = taken[r["doc_id"]]
        while left > 0:
            text = r["text"] if left >= size else " ".join(WORD.findall(r["text"])[:left])
            ids = library.encode_ordinary(text)
            want.append((r["doc_id"], len(ids), sha256(",".join(map(str, ids)).encode()).hexdigest(), sha256(text.encode()).hexdigest()))
            left -= size
    got = [tuple(r) for r in corpus_pipeline.run(spark, FOLDER).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256").collect()]
    assert sorted(got) == sorted(want)

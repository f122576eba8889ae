"""Exact deduplication by skew-safe combining.

Three stages, and full content is compared in each: (1) every task folds its own rows, in windows of bounded size; (2) of texts
whose digest several windows have, the windows' winners meet in salted groups (digest, salt, content); (3) the winners of the salts
meet in (digest, content). A text that a third of all rows hold therefore reaches stage 2 once per window, spread over the salts,
and stage 3 once per salt. Texts whose digest no other window has never move.

Cases: a null text counts as empty; texts are equal when identical after deleting space and 0x09-0x0D; of equal texts the one with
most code points stays, then the smallest doc_id (nulls last), then any one of rows that agree in both. Rows that repeat a doc_id
stay rows of their own. An empty table gives an empty result; other columns are carried by ``unique_rows`` and ignored by ``groups``.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from tallyline.llm.common import free_name, let_go, materialise, semi_join

DELETED = " \t\n\x0b\x0c\r"
WINDOW_BYTES = 8 << 20
SALTS = 16
ADDED = "gid bigint, digest string, length bigint, winner boolean, local_id {id}, local_count bigint"


def _fold(batches: Iterator[pa.RecordBatch], id_column: str, text: str, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Stage 1: append to each row its window's group, and drop the text of all but the group's winner."""
    let_go()
    part, made = TaskContext.get().partitionId() << 33, 0
    held: list[pa.RecordBatch] = []
    size = 0

    def flush() -> Iterator[pa.RecordBatch]:
        nonlocal held, size, made
        table = pa.Table.from_batches(held)
        texts = table[text].combine_chunks()
        lengths = pc.utf8_length(texts.fill_null("")).to_pylist()
        ids = table[id_column].to_pylist()
        seen: dict[bytes, list[list]] = {}           # digest -> groups of different content: [content, members]
        groups, digests = [], []
        for i, raw in enumerate(texts.cast(pa.binary())):
            content = (raw.as_py() or b"").translate(None, DELETED.encode())
            digest = sha256(content)
            digests.append(digest.hexdigest())
            same = seen.setdefault(digest.digest(), [])
            group = next((g for g in same if g[0] == content), None)
            if group is None:
                same.append(group := [content, []])
                groups.append(group)
            group[1].append(i)
        n = len(ids)
        gid, winner, local_id, count = [0] * n, [False] * n, [None] * n, [0] * n
        for _, members in groups:
            best = min(members, key=lambda i: (-lengths[i], ids[i] is None, ids[i] or 0, i))
            winner[best] = True
            for i in members:
                gid[i], local_id[i], count[i] = part + made, ids[best], len(members)
            made += 1
        table = table.set_column(table.schema.get_field_index(text), text, pc.if_else(pa.array(winner), texts, pa.scalar(None, texts.type)))
        for name, values in zip(schema.names[-6:], (gid, digests, lengths, winner, local_id, count)):
            table = table.append_column(schema.field(name), pa.array(values, schema.field(name).type))
        held, size = [], 0
        yield from table.cast(schema).to_batches(max_chunksize=4096)

    for batch in batches:
        for at in range(0, batch.num_rows, 512):
            held.append(batch.slice(at, 512))
            size += held[-1].nbytes
            if size >= WINDOW_BYTES:
                yield from flush()
    if held:
        yield from flush()


def fold_locally(docs: DataFrame, id_column: str = "doc_id", text: str = "text") -> tuple[DataFrame, dict[str, str]]:
    """Stage 1 as a written table, and the names its added columns got."""
    added = [f.split(" ", 1) for f in ADDED.format(id=docs.schema[id_column].dataType.simpleString()).split(", ")]
    names = {plain: free_name(plain, docs.columns) for plain, _ in added}
    schema = docs.selectExpr("*", *(f"CAST(NULL AS {kind}) AS `{names[plain]}`" for plain, kind in added)).schema
    arrow = to_arrow_schema(schema)
    folded = docs.mapInArrow(lambda batches: _fold(batches, id_column, text, arrow), schema)
    return materialise(folded, "dedup-folded"), names


def combine(folded: DataFrame, names: dict[str, str], id_column: str = "doc_id", text: str = "text", salts: int = SALTS) -> DataFrame:
    """Stages 2 and 3: gid, keep_gid, keep_id, group_size of each window group whose digest another window group has too."""
    c = {k: F.col(f"`{v}`") for k, v in names.items()}
    winners = folded.filter(c["winner"]).select(
        c["gid"].alias("gid"), c["digest"].alias("digest"), c["length"].alias("length"), c["local_count"].alias("n"), F.col(f"`{id_column}`").alias("id"), F.col(f"`{text}`").alias("text"))
    repeated = materialise(winners.groupBy("digest").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("digest"), "dedup-digests")
    met = semi_join(winners, repeated, "digest").select(
        "gid", "digest", "n", F.translate(F.coalesce("text", F.lit("")), DELETED, "").alias("content"), F.pmod(F.xxhash64("gid"), F.lit(salts)).alias("salt"),
        F.struct((-F.col("length")).alias("less"), F.col("id").isNull().alias("without"), F.col("id"), F.col("gid")).alias("best"))
    met = materialise(met, "dedup-repeated")
    salted = met.groupBy("digest", "salt", "content").agg(F.min("best").alias("best"), F.sum("n").alias("n"))
    whole = salted.groupBy("digest", "content").agg(F.min("best").alias("best"), F.sum("n").alias("n"))
    joined = met.select("gid", "digest", "content").join(whole, ["digest", "content"])
    return joined.select("gid", F.col("best.gid").alias("keep_gid"), F.col("best.id").alias("keep_id"), F.col("n").alias("group_size"))


def groups(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): doc_id, keep_id, group_size, kept, text_sha256."""
    folded, names = fold_locally(docs.select("doc_id", "text"))
    met = combine(folded, names)
    own = folded.select("doc_id", "gid", "digest", "winner", "local_id", "local_count")
    joined = own.join(met, "gid", "left")
    return joined.select(
        "doc_id", F.when(F.col("keep_gid").isNull(), F.col("local_id")).otherwise(F.col("keep_id")).alias("keep_id"),
        F.coalesce("group_size", "local_count").alias("group_size"), (F.col("winner") & (F.coalesce("keep_gid", "gid") == F.col("gid"))).alias("kept"), F.col("digest").alias("text_sha256"))


def unique_rows(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns."""
    folded, names = fold_locally(docs)
    gid = names["gid"]
    lost = materialise(combine(folded, names).filter("gid <> keep_gid").select(F.col("gid").alias(gid)), "dedup-lost")
    stay = semi_join(folded.filter(F.col(f"`{names['winner']}`")), lost, gid, "left_anti")
    return stay.select(*[F.col(f"`{c}`") for c in docs.columns])

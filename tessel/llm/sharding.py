"""Sharding by fixed virtual slots.

Records hash into a fixed number of virtual slots. Bytes are aggregated for each slot, and a versioned table maps
slots to shards. Version 1 deals the slots out evenly, before any size is known. Rebalancing edits the map, never the
hash: a new version moves whole slots from shards that are too full. The law here is `bytes`: shards are near equal in
bytes. A record hashes by its doc_id, size and checksum together, so no doc_id, null or not, makes a heavy slot.

Only the table of slots, of a fixed number of rows, is ever on the driver or broadcast.
"""

from __future__ import annotations

import heapq

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessel.llm.common import new_path, written

SLOTS = 4096


def hashed(docs: DataFrame, slots: int = SLOTS) -> DataFrame:
    """(doc_id, size, text_crc32, virtual_slot), a row for each row of docs."""
    text = F.coalesce("text", F.lit(""))
    out = docs.select("doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
    name = F.md5(F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("")), "size", "text_crc32"))
    return out.withColumn("virtual_slot", (F.conv(F.substring(name, 1, 8), 16, 10).cast("long") % slots).cast("int"))


class SlotMap:
    """Versions of the slot-to-shard table, each written whole to the shared folder as (version, slot, bytes, shard)."""

    def __init__(self, spark: SparkSession, path: str | None = None) -> None:
        self.spark, self.path = spark, path or new_path(spark, "slot_map")

    def create(self, sizes: dict[int, int], shards: int, slots: int = SLOTS) -> list[tuple[int, int, int]]:
        """Version 1: the largest slot first, each to the emptiest shard, of equals to that with the fewest slots."""
        heap = [(0, 0, k) for k in range(shards)]
        rows = []
        for slot in sorted(range(slots), key=lambda s: (-sizes.get(s, 0), s)):
            total, n, k = heapq.heappop(heap)
            rows.append((slot, sizes.get(slot, 0), k))
            heapq.heappush(heap, (total + sizes.get(slot, 0), n + 1, k))
        return self._store(1, rows)

    def rebalance(self, rows: list[tuple[int, int, int]], sizes: dict[int, int], shards: int, version: int) -> list[tuple[int, int, int]]:
        """The next version for new sizes or another number of shards; moves as few slots as the balance needs.

        A shard gives the largest slots that fit into what it has above the mean; of those the largest goes first to
        the emptiest shard.
        """
        held: dict[int, list[tuple[int, int]]] = {k: [] for k in range(shards)}
        homeless = []
        for slot, _, shard in rows:
            (held[shard] if shard < shards else homeless).append((sizes.get(slot, 0), slot))
        total = {k: sum(n for n, _ in v) for k, v in held.items()}
        whole = sum(total.values()) + sum(n for n, _ in homeless)
        for k, own in held.items():
            stay = []
            for n, slot in sorted(own, reverse=True):
                if n and n * shards <= total[k] * shards - whole:
                    total[k] -= n
                    homeless.append((n, slot))
                else:
                    stay.append((n, slot))
            held[k] = stay
        heap = [(n, k) for k, n in total.items()]
        heapq.heapify(heap)
        for n, slot in sorted(homeless, key=lambda x: (-x[0], x[1])):
            so_far, k = heapq.heappop(heap)
            held[k].append((n, slot))
            heapq.heappush(heap, (so_far + n, k))
        return self._store(version, sorted((slot, n, k) for k, own in held.items() for n, slot in own))

    def _store(self, version: int, rows: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
        """Writes a version to a folder of its own; a version that is there already is an error."""
        table = self.spark.createDataFrame([(version, *r) for r in rows], "version int, slot int, bytes long, shard int")
        table.coalesce(1).write.mode("error").parquet(f"{self.path}/version={version}")
        return sorted(rows)

    def load(self, version: int) -> DataFrame:
        return self.spark.read.schema("slot int, bytes long, shard int").parquet(f"{self.path}/version={version}")


def slot_sizes(rows: DataFrame) -> dict[int, int]:
    """Bytes of each virtual slot: a map-side combined sum, one row for each slot at most."""
    return {r["virtual_slot"]: r["n"] for r in rows.groupBy("virtual_slot").agg(F.sum("size").alias("n")).collect()}


def sharded(docs: DataFrame, shards: int = 16, slots: int = SLOTS) -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard, virtual_slot), a row for each row of docs.

    size: UTF-8 bytes of the text plus 1 (null text: 1). law: `bytes`, so grown_shard is null. Shards come from
    version 2 of the map: version 1 deals slots out in turn, the bytes found in the slots make the edit. slot numbers
    the rows of a shard from 0 without gaps: each virtual slot's rows by doc_id (null first), size and checksum, virtual
    slots one after another. Repeated rows are placed each, next to one another; they are counted, not sorted. An empty
    table gives an empty one; other columns are ignored.
    """
    rows = written(hashed(docs, slots), "slots")
    table = SlotMap(docs.sparkSession)
    table.rebalance(table.create({}, shards, slots), slot_sizes(rows), shards, 2)
    home = table.load(2).select(F.col("slot").alias("virtual_slot"), "shard")
    held = rows.groupBy("virtual_slot").count().join(home, "virtual_slot")
    before = Window.partitionBy("shard").orderBy("virtual_slot").rowsBetween(Window.unboundedPreceding, -1)
    home = held.select("virtual_slot", "shard", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("first"))
    alike = rows.groupBy("virtual_slot", "doc_id", "size", "text_crc32").count()
    place = Window.partitionBy("virtual_slot").orderBy("doc_id", "size", "text_crc32").rowsBetween(Window.unboundedPreceding, -1)
    alike = alike.withColumn("at", F.coalesce(F.sum("count").over(place), F.lit(0)))
    each = alike.join(F.broadcast(home), "virtual_slot")  # as many rows as slots
    each = each.withColumn("slot", F.explode(F.sequence(F.col("first") + F.col("at"), F.col("first") + F.col("at") + F.col("count") - 1)))
    return each.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", F.col("slot").cast("long"), F.lit(None).cast("int").alias("grown_shard"), "virtual_slot")


#: The rows of sharded() with 16 shards, for DuckDB, which has no CRC-32: its table comes from the polynomial.
SQL = f"""
    with recursive crc_table as (
        select list(c order by i) as t from (
            select i, list_reduce([cast(i as bigint)] || [0 for _ in range(8)], lambda c, z: case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end) as c from range(256) x(i))
    ), rows_ as (
        select doc_id, cast(strlen(coalesce(text, '')) + 1 as bigint) as size,
            xor(4294967295, list_reduce([4294967295] || [cast('0x' || b as bigint) for b in regexp_extract_all(hex(encode(coalesce(text, ''))), '..')],
                lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1]))) as text_crc32
        from documents, crc_table
    ), placed as (
        select *, cast(cast('0x' || substr(md5(coalesce(cast(doc_id as varchar), '') || ':' || size || ':' || text_crc32), 1, 8) as bigint) % {SLOTS} as int) as virtual_slot from rows_
    ), sizes as (
        select s as virtual_slot, s % 16 as shard, cast(coalesce(sum(size), 0) as bigint) as n from range({SLOTS}) x(s) left join placed on virtual_slot = s group by s
    ), whole as (
        select cast(sum(n) as bigint) as n from sizes
    ), ordered as (
        select *, row_number() over (partition by shard order by n desc, virtual_slot desc) as i from sizes
    ), walk as (
        select shard, 0::bigint as i, cast(sum(n) as bigint) as total, -1::bigint as gone from sizes group by shard
        union all
        select w.shard, o.i, case when fits then w.total - o.n else w.total end, case when fits then o.virtual_slot else -1 end
        from (select w.*, o.virtual_slot, o.n, o.i as oi, o.n > 0 and o.n * 16 <= w.total * 16 - whole.n as fits from walk w join ordered o on o.shard = w.shard and o.i = w.i + 1, whole) w
            join ordered o on o.virtual_slot = w.virtual_slot
    ), homeless as (
        select virtual_slot, n, row_number() over (order by n desc, virtual_slot) as j from sizes where virtual_slot in (select gone from walk)
    ), dealt as (
        select 0::bigint as j, (select list(total order by shard) from walk where i = {SLOTS} / 16) as loads, -1::bigint as virtual_slot, -1::bigint as shard
        union all
        select h.j, [case when k = p then loads[k] + h.n else loads[k] end for k in range(1, 17)], h.virtual_slot, p - 1
        from (select *, list_position(loads, list_min(loads)) as p from dealt) d join homeless h on h.j = d.j + 1
    )
    select doc_id, size, text_crc32, 'bytes' as law, cast(coalesce(d.shard, s.shard) as int) as shard,
        row_number() over (partition by coalesce(d.shard, s.shard) order by p.virtual_slot, doc_id nulls first, size, text_crc32) - 1 as slot,
        cast(null as int) as grown_shard, p.virtual_slot
    from placed p join sizes s on p.virtual_slot = s.virtual_slot left join dealt d on d.virtual_slot = p.virtual_slot
"""

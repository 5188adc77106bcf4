"""Queries over the metadata of channels and axes, field by field, in documents that a rule fills."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessel.functions import metadata
from tessel.plans.core import query
from tessel.session import spread


@dataclass
class Node:
    """An element of the channel's schema: a value of a kind, or children and attributes (those whose name begins with _)."""

    name: str
    kind: str = ""
    many: bool = False
    children: list[Node] = field(default_factory=list)


def _parts(text: str) -> list[str]:
    """The text at its commas that stand in no angle brackets."""
    out, depth, now = [], 0, ""
    for c in text:
        depth += (c == "<") - (c == ">")
        if c == "," and not depth:
            out.append(now)
            now = ""
        else:
            now += c
    return [p.strip() for p in [*out, now] if p.strip()]


def nodes(ddl: str) -> list[Node]:
    """The fields of column definitions."""
    out = []
    for part in _parts(ddl):
        at = min(k for k in (part.find(" "), part.find(":")) if k > 0)
        node, kind = Node(part[:at]), part[at + 1 :].strip()
        if kind.startswith("ARRAY<"):
            node.many, kind = True, kind[6:-1]
        if kind.startswith("STRUCT<"):
            node.children = nodes(kind[7:-1])
        else:
            node.kind = kind
        out.append(node)
    return out


_TREE = nodes(metadata.CHANNEL)


def leaves(tree: list[Node], path: tuple[Node, ...] = ()) -> list[tuple[Node, ...]]:
    return [x for n in tree for x in (leaves(n.children, (*path, n)) if n.children else [(*path, n)])]


_LEAVES = leaves(_TREE)
_PLACE = {id(p[-1]): k for k, p in enumerate(_LEAVES)}


def _rule(n: int, kind: str, sql: bool):
    """What field n holds in channel i of document k, as text; a quarter of the documents lack it."""
    there = f"(k + {n}) % 4 <> 0"
    number = f"(k * {n + 3} + i) % 97"
    to_text = f"cast({number} as {'varchar' if sql else 'string'})"
    value = {"DOUBLE": f"concat({to_text}, '.5')", "INT": to_text, "BOOLEAN": f"case when (k + i) % 2 = 0 then 'true' else 'false' end"}.get(kind, f"concat('f{n}v', {to_text})")
    return f"case when {there} then {value} end"


def _xml(node: Node) -> Column:
    """An element by the rule; a value that is not there has none."""
    if not node.children:
        return F.coalesce(F.concat(F.lit(f"<{node.name}>"), F.expr(_rule(_PLACE[id(node)], node.kind, False)), F.lit(f"</{node.name}>")), F.lit(""))
    inner = F.concat(F.lit(""), *[_xml(c) for c in node.children if not c.name.startswith("_")])
    own = [(c.name[1:], F.expr(_rule(_PLACE[id(c)], c.kind, False))) for c in node.children if c.name.startswith("_")]
    attributes = F.concat(F.lit(""), *[F.coalesce(F.concat(F.lit(f' {n}="'), v, F.lit('"')), F.lit("")) for n, v in own])
    return F.concat(F.lit(f"<{node.name}"), attributes, F.lit(">"), inner, F.lit(f"</{node.name}>"))


def _documents(spark, d) -> DataFrame:
    """A document for each customer with two channels."""
    each = spread(spark.read.parquet(f"{d}/customer.parquet").select("c_custkey")).select(F.col("c_custkey").alias("k"), F.explode(F.array(F.lit(0), F.lit(1))).alias("i"))
    own = each.select("k", F.struct("i", _xml(Node("Channel", children=_TREE)).alias("x")).alias("c"))
    return own.groupBy("k").agg(F.array_join(F.transform(F.sort_array(F.collect_list("c")), lambda c: c["x"]), "").alias("xml")).select(  # two channels
        F.col("k").alias("doc_id"), F.concat(F.lit("<ImageDocument><Metadata><Information><Image><Dimensions><Channels>"), "xml", F.lit("</Channels></Dimensions></Image></Information></Metadata></ImageDocument>")).alias("xml")
    )


def _got(path: tuple[Node, ...]) -> Column:
    out = F.col(path[0].name)
    for k, n in enumerate(path):
        out = out if k == 0 else out[n.name]
        out = F.get(out, F.lit(0)) if n.many else out
    return out.cast("string")


_NAMED = {"/".join(n.name for n in p): p for p in _LEAVES}


@query("channel_fields", " union all ".join(f"select k as doc_id, cast(i as int) as channel, '{name}' as field, {_rule(k, p[-1].kind, True)} as value from (select c_custkey as k, i from customer, range(2) t(i)) where (k + {k}) % 4 <> 0" for k, (name, p) in enumerate(_NAMED.items())))
def _(spark, d):
    c = metadata.channels(_documents(spark, d))
    each = F.array(*[F.struct(F.lit(name).alias("field"), _got(p).alias("value")) for name, p in _NAMED.items()])
    return c.select("doc_id", "channel", F.inline(each)).where("value is not null")


def _axes(spark, d) -> DataFrame:
    """A document for each customer with Z and T axes, each in an interval or a list."""
    k = F.col("c_custkey")
    e = lambda name, value: F.concat(F.lit(f"<{name}>"), value.cast("string"), F.lit(f"</{name}>"))
    maybe = lambda n, x: F.when(k % n != 0, x).otherwise("")
    interval = F.concat(F.lit("<Positions><Interval>"), e("Start", k % 11), e("Increment", F.lit(0.5)), F.lit("</Interval></Positions>"))
    listed = F.concat(F.lit("<Positions><List><Offsets>"), (k % 7).cast("string"), F.lit(" 1.5  -2.25</Offsets></List></Positions>"))
    where = F.when(k % 2 == 0, interval).otherwise(listed)
    more = [maybe(3, e("XYZHandedness", F.lit("LeftHanded"))), maybe(4, e("ZAxisDirection", F.lit("FromSpecimenToObjective"))), maybe(5, e("ZDriveMode", F.lit("Continuous"))), maybe(6, e("ZDriveSpeed", k * 0.25))]
    z = F.concat(F.lit("<Z>"), maybe(3, e("StartPosition", k * 0.5)), where, *more, F.lit("</Z>"))
    t = F.concat(F.lit("<T>"), maybe(3, e("StartTime", F.concat(F.lit("2020-01-0"), k % 9 + 1, F.lit("T00:00:00Z")))), where, F.lit("</T>"))
    xml = F.concat(F.lit("<ImageDocument><Metadata><Information><Image><Dimensions>"), z, t, F.lit("</Dimensions></Image></Information></Metadata></ImageDocument>"))
    return spread(spark.read.parquet(f"{d}/customer.parquet").select("c_custkey")).select(k.alias("doc_id"), xml.alias("xml"))


_INTERVAL = "case when k % 2 = 0 then cast(k % 11 as double) end as interval_start, case when k % 2 = 0 then 0.5::double end as increment, case when k % 2 = 1 then cast(k % 7 as double) end as first, case when k % 2 = 1 then -2.25::double end as last"
_KEYS = "(select c_custkey as k from customer)"


def _with_offsets(axis: DataFrame) -> DataFrame:
    return axis.withColumns({"first": F.get("offsets", F.lit(0)), "last": F.get("offsets", F.lit(2))}).drop("offsets")


@query("z_axis", f"select k as doc_id, case when k % 3 <> 0 then k * 0.5::double end as start, {_INTERVAL}, case when k % 3 <> 0 then 'LeftHanded' end as handedness, case when k % 4 <> 0 then 'FromSpecimenToObjective' end as direction, case when k % 5 <> 0 then 'Continuous' end as drive_mode, case when k % 6 <> 0 then k * 0.25::double end as drive_speed from {_KEYS}")
def _(spark, d):
    return _with_offsets(metadata.axis_info(_axes(spark, d), "Z"))


@query("t_axis", f"select k as doc_id, case when k % 3 <> 0 then concat('2020-01-0', cast(k % 9 + 1 as varchar), 'T00:00:00Z') end as start, {_INTERVAL} from {_KEYS}")
def _(spark, d):
    return _with_offsets(metadata.axis_info(_axes(spark, d), "T"))

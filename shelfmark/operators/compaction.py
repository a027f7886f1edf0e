"""History compaction: smaller tool payloads, superseded reads and their statistics."""

from __future__ import annotations

import json
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from decimal import Decimal

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shelfmark.functions import fixed_values as fv
from shelfmark.functions.scale import exact_ranks, running, settled

# Exchange fields the recorded field list leaves out; kept by default.
EXCHANGE_FIELDS = ["exchange_items", "exchange_new_items", "exchange_payment_method_id", "exchange_price_difference"]
READ_TOOLS = ["get_order", "check_return_eligibility", "get_order_details", "get_user_details", "get_product", "get_product_details"]


@dataclass(frozen=True)
class Part:
    """One rule: what of a payload is kept at ``path`` of the given tools' results.

    ``kind``: ``merge`` (fields of the result itself), ``object`` (one object), ``list``
    (objects of a list), ``map`` (objects of a map, in their order), ``texts`` (strings
    of a list) or ``raw`` (the value as it is). ``first``/``last`` cap the number of
    elements, ``chars`` the characters of a text. ``needed`` parts are written even when
    the result has none; ``inside`` are further parts of each object; ``or_self`` takes
    the result itself where the path is missing; ``beside`` are fields written as they
    are, nulls included, and ``text`` is a field cut to ``chars``.
    """

    tools: tuple[str, ...]
    path: str
    kind: str
    fields: tuple[str, ...] = ()
    first: int | None = None
    last: int | None = None
    chars: int | None = None
    needed: bool = False
    or_self: bool = False
    inside: tuple["Part", ...] = ()
    beside: tuple[str, ...] = ()
    text: str | None = None
    loose: bool = False  # elements that are no objects count as empty ones instead of being left out


_ANY: tuple[str, ...] = ()
_ITEM, _PRODUCT = tuple(fv.COMPACT_ITEM_FIELDS), tuple(fv.COMPACT_PRODUCT_FIELDS)
ORDER_PARTS = (
    Part(_ANY, "items", "list", _ITEM, first=12),
    Part(_ANY, "payment_history", "list", tuple(fv.COMPACT_PAYMENT_FIELDS), last=4),
    Part(_ANY, "fulfillments", "list", tuple(fv.COMPACT_FULFILLMENT_FIELDS)),
)
PRODUCT_PARTS = (Part(_ANY, "variants", "map", _ITEM, first=24),)
WRITES = tuple([*fv.RETAIL_WRITE_TOOLS, "create_return_request"])


def payload_rules(order_fields: list[str] | None = None) -> list[Part]:
    """The rule table. ``order_fields`` replaces the kept order fields (exchange fields are kept by default)."""
    order = tuple(fv.COMPACT_ORDER_FIELDS + EXCHANGE_FIELDS if order_fields is None else order_fields)
    return [
        Part(("search_catalog",), "items", "list", _PRODUCT, first=12, needed=True, loose=True),
        Part(("get_product",), "product", "object", _PRODUCT, needed=True, or_self=True, inside=PRODUCT_PARTS),
        Part(("get_product",), "evidence", "texts", first=3, chars=600),
        Part(("compare_products",), "products", "list", (), first=12, needed=True, beside=("ok",), inside=(Part(_ANY, "product", "object", _PRODUCT, needed=True, or_self=True, inside=PRODUCT_PARTS),)),
        Part(("get_policy",), "policies", "list", ("doc_id", "title"), first=3, needed=True, chars=800, text="text"),
        Part(("get_order", "check_return_eligibility"), "order", "object", order, needed=True, inside=ORDER_PARTS),
        Part(("get_order_details", *WRITES), "", "merge", order, inside=ORDER_PARTS),
        Part(("get_product_details",), "", "merge", _PRODUCT, inside=PRODUCT_PARTS),
        Part(("get_user_details",), "", "merge", ("user_id", "name", "address", "email", "payment_methods", "orders")),
        *[Part(_ANY, key, "raw") for key in ("order", "product", "items", "policies")],
    ]


_MAP, _LIST = "map<string,variant>", "array<variant>"


def _let(value: Column, then: Callable[[Column], Column]) -> Column:
    """``then(value)`` with ``value`` computed once a row."""
    return F.transform(F.array(value), then)[0]


def _quoted(text: Column) -> Column:
    listed = F.to_json(F.array(text))
    return F.substring(listed, F.lit(2), F.length(listed) - 2)


def _there(v: Column) -> Column:
    """The value, null for a JSON null."""
    return F.when(~F.is_variant_null(v), v)


def _shown(v: Column) -> Column:
    """The value, a JSON null where there is none, so that it is written in any case."""
    return F.coalesce(v, F.parse_json(F.lit("null")))


def _of(m: Column) -> Callable[[str], Column]:
    return lambda name: F.try_element_at(m, F.lit(name))


def _within(get: Callable[[str], Column], part: Part, nulls: Column, own: Column) -> Column:
    """One object under a rule: its fields, then the fields beside, the text and the parts inside.

    ``get`` reads a field of the object, ``own`` is the object as a map where parts inside are asked for.
    """
    columns = [_there(get(f)).alias(f) for f in part.fields] + [_shown(get(f)).alias(f) for f in part.beside]
    if part.text is not None:
        value = F.coalesce(F.try_variant_get(get(part.text), "$", "string"), F.lit(""))
        columns.append(F.substring(value, 1, part.chars).alias(part.text))
    return F.struct(*columns, *[_piece(own, p, nulls).alias(p.path) for p in part.inside])


def _cut(elements: Column, part: Part) -> Column:
    if part.first is not None:
        return F.slice(elements, 1, part.first)
    if part.last is not None:
        return _let(elements, lambda e: F.when(F.size(e) > part.last, F.slice(e, -part.last, part.last)).otherwise(e))
    return elements


def _element(part: Part) -> str:
    """Type that elements are read as: the fields of the rule alone, or all where parts of the element are asked for."""
    if part.inside or part.beside or not part.fields:
        return _MAP
    return "struct<" + ",".join(f"`{f}`:variant" for f in (*part.fields, *([part.text] if part.text else []))) + ">"


def _kept(elements: Column, part: Part, kind: str, nulls: Column) -> Column:
    """The elements of a list under a rule; read as its fields and without a JSON null to drop, they are kept as they are."""
    shown = F.transform(elements, lambda e: _within(_of(e) if kind == _MAP else lambda f: e[f], part, nulls, e))
    return shown if kind == _MAP or part.text or part.loose else F.when(nulls, shown).otherwise(elements)


def _piece(m: Column, part: Part, nulls: Column) -> Column:
    """What one rule keeps of an object, as a value ``to_json`` writes; null where the payload has none."""
    value = F.try_element_at(m, F.lit(part.path))
    if part.kind == "raw":
        return F.when(F.map_contains_key(m, F.lit(part.path)), _shown(value))
    if part.kind == "object":
        inner = _let(F.try_variant_get(value, "$", _MAP), lambda o: F.when(F.size(o) > 0, o))
        return _let(F.coalesce(inner, m) if part.or_self else inner, lambda o: _within(_of(o), part, nulls, o))
    if part.kind == "texts":
        text = lambda v: F.substring(F.coalesce(F.try_variant_get(v, "$", "string"), F.to_json(v)), 1, part.chars)
        return F.transform(_cut(F.try_variant_get(value, "$", _LIST), part), text)
    kind = _element(part)
    if part.kind == "map":
        entries = F.filter(_cut(F.map_entries(F.try_variant_get(value, "$", f"map<string,{kind}>")), part), lambda e: e["value"].isNotNull())
        return _let(entries, lambda es: F.map_from_arrays(F.transform(es, lambda e: e["key"]), _kept(F.transform(es, lambda e: e["value"]), part, kind, nulls)))
    listed = _cut(F.try_variant_get(value, "$", f"array<{kind}>"), part)
    shown = _let(listed if part.loose else F.filter(listed, lambda o: o.isNotNull()), lambda es: _kept(es, part, kind, nulls))
    if part.needed:
        return F.coalesce(shown, F.array())
    # an order's items are listed as soon as the key is there, other lists only where they are lists
    return F.coalesce(shown, F.when(F.map_contains_key(m, F.lit(part.path)), F.array())) if part.path == "items" else shown


def compact_payload(tool: Column, result: Column, order_fields: list[str] | None = None) -> Column:
    """Compact JSON text of a tool result by the rule table; the result is parsed once and written by one ``to_json``.

    Text that is no object stays as it is (written as JSON); an object of which nothing
    is kept stays whole. Entries of a map are taken in the order of their names.
    """
    rules = payload_rules(order_fields)
    base_fields = tuple(fv.COMPACT_BASE_FIELDS)

    def of_tool(m: Column, there: Column, nulls: Column, name: str | None) -> Column:
        columns = [_of(there)(f).alias(f) for f in base_fields]
        for p in (p for p in rules if (name in p.tools if name is not None else not p.tools)):
            if p.kind == "merge":
                columns += [_of(there)(f).alias(f) for f in p.fields if f not in base_fields]
                columns += [_piece(m, i, nulls).alias(i.path) for i in p.inside]
            else:
                columns.append(_piece(m, p, nulls).alias(p.path))
                if p.kind == "object":
                    columns.append(F.when(columns[-1].isNull(), F.from_json(F.lit("{}"), "map<string,string>")).alias(p.path))
        return F.to_json(F.struct(*columns), {"ignoreNullFields": "true"})

    def chosen(m: Column, there: Column, nulls: Column) -> Column:
        shapes: dict[tuple, list[str]] = {}
        for name in dict.fromkeys(n for p in rules for n in p.tools):
            shapes.setdefault(tuple(p for p in rules if name in p.tools), []).append(name)
        out = F
        for names in shapes.values():
            out = out.when(tool.isin(names), of_tool(m, there, nulls, names[0]))
        return out.otherwise(of_tool(m, there, nulls, None))

    def built(m: Column) -> Column:
        def of(nulls: Column) -> Column:
            there = F.when(nulls, F.map_filter(m, lambda k, v: ~F.is_variant_null(v))).otherwise(m)
            return _let(there, lambda t: chosen(m, t, nulls))

        text = _let(F.contains(result, F.lit("null")), of)  # a JSON null has no other spelling
        return _let(text, lambda t: F.when(t == "{}", F.to_json(F.try_parse_json(result))).otherwise(t))

    other = F.coalesce(F.to_json(F.try_parse_json(result)), _quoted(result))
    return _let(F.from_json(result, _MAP), lambda m: F.when(m.isNull(), other).otherwise(built(m)))


def entity(tool: Column, result: Column) -> Column:
    """Id of the entity a read returned, null for other tools."""
    path = {
        "get_order": "$.order.order_id", "check_return_eligibility": "$.order.order_id", "get_order_details": "$.order_id",
        "get_user_details": "$.user_id", "get_product": "$.product.product_id", "get_product_details": "$.product_id",
    }
    out = None
    for name, p in path.items():
        v = F.nullif(F.get_json_object(result, p), F.lit(""))
        out = F.when(tool == name, v) if out is None else out.when(tool == name, v)
    return out


def placeholder(tool: Column, entity_id: Column, result: Column) -> Column:
    """What stands for a read that a later one replaces; ``ok`` is the read's own (true where it has none)."""
    key = F.concat(F.regexp_replace(F.regexp_replace(tool, "^get_", ""), "_details$", ""), F.lit("_id"))
    v = F.try_parse_json(result)
    ok = F.coalesce(F.to_json(F.try_variant_get(v, "$.ok", "variant")), F.when(F.array_contains(F.json_object_keys(result), "ok"), "null"), F.lit("true"))
    return F.concat(F.lit('{"ok":'), ok, F.lit(',"superseded_by_later_read":true,"'), key, F.lit('":'), _quoted(entity_id), F.lit("}"))


def compact_history(history: DataFrame) -> DataFrame:
    """``history(conv, pos, role, tool, content)`` with the compact text of each message.

    A read is superseded when the same entity is read later; the last position per
    (conversation, tool, entity) is a partial aggregate joined back.
    """
    h = history.withColumn("entity_id", F.when(F.col("role") == "tool", entity(F.col("tool"), F.col("content"))))
    last = h.where(F.col("entity_id").isNotNull()).groupBy("conv", "tool", "entity_id").agg(F.max("pos").alias("last_pos"))
    j = h.join(last, ["conv", "tool", "entity_id"], "left")
    old = F.coalesce(F.col("last_pos") != F.col("pos"), F.lit(False))
    row = F.struct("role", "tool", "entity_id", "content", old.alias("old"))
    compact = _let(row, lambda r: F.when(r["role"] != "tool", r["content"]).when(r["old"], placeholder(r["tool"], r["entity_id"], r["content"])).otherwise(compact_payload(r["tool"], r["content"])))
    return j.select("conv", "pos", "role", "tool", "entity_id", "content", old.alias("superseded"), compact.alias("compact"))


def stats(compacted: DataFrame) -> DataFrame:
    tool = F.col("role") == "tool"
    raw, small = F.length("content"), F.length("compact")
    return compacted.groupBy("conv").agg(
        F.sum(raw).alias("raw_chars"),
        F.sum(small).alias("compact_chars"),
        F.sum(F.when(tool, raw).otherwise(0)).alias("raw_tool_chars"),
        F.sum(F.when(tool, small).otherwise(0)).alias("compact_tool_chars"),
        F.count_if(tool).alias("tool_messages"),
    ).withColumn("reduction_ratio", F.when(F.col("raw_chars") > 0, 1.0 - F.col("compact_chars") / F.col("raw_chars")).otherwise(0.0))


def prefix_sizes(compacted: DataFrame, block: int = 4096) -> DataFrame:
    """Raw and compact size of everything before each message, as the history stood then.

    Inside a prefix a read is full size until a later read of the same entity, from
    where on it counts as its placeholder: each later read carries the difference
    of the read before it. So the compact size is a running sum too, and no prefix
    is scanned again.
    """
    c = compacted.withColumns(
        {
            "full": F.when(F.col("role") == "tool", F.length(compact_payload(F.col("tool"), F.col("content")))).otherwise(F.length("content")),
            "short": F.when(F.col("entity_id").isNotNull(), F.length(placeholder(F.col("tool"), F.col("entity_id"), F.col("content")))),
        }
    )
    # payloads are measured once; from here on only lengths are read
    c = settled(c.select("conv", "pos", "role", "tool", "entity_id", "full", "short", F.length("content").alias("raw_len")))
    reads = c.where(F.col("entity_id").isNotNull()).select("conv", "pos", "tool", "entity_id", "full", "short")
    prior = running(
        reads, ["conv", "tool", "entity_id"], ["pos"], F.floor(F.col("pos") / block),
        lasts={"saved": F.col("full") - F.col("short")}, before_only=True,
    ).select("conv", "pos", F.coalesce("saved", F.lit(0)).alias("saved"))
    sized = c.join(prior, ["conv", "pos"], "left").withColumn("delta", F.col("full") - F.coalesce("saved", F.lit(0)))
    out = running(
        sized, ["conv"], ["pos"], F.floor(F.col("pos") / block),
        sums={"raw_prefix": F.col("raw_len").cast("bigint"), "compact_prefix": F.col("delta").cast("bigint")}, before_only=True,
    )
    return out.select("conv", "pos", "role", "raw_prefix", "compact_prefix")


def report(per_conversation: DataFrame) -> DataFrame:
    """Totals, overall ratio, mean, median and floor-rank P95 of the reductions."""
    t = per_conversation.agg(
        F.count(F.lit(1)).alias("conversations"),
        F.sum("raw_chars").alias("raw_chars_total"),
        F.sum("compact_chars").alias("compact_chars_total"),
        F.avg("reduction_ratio").alias("reduction_mean"),
    ).withColumn("j", F.lit(1))
    q = exact_ranks(per_conversation, [], "reduction_ratio", {"reduction_p50": ("inclusive", 0.5), "reduction_p95": ("floor", 0.95)}).withColumn("j", F.lit(1))
    return t.join(q, "j").drop("j").withColumn("character_reduction_ratio", 1.0 - F.col("compact_chars_total") / F.col("raw_chars_total"))


def _leaf_counts(text: str | None) -> Counter:
    """(path, value) -> occurrences: every leaf of one JSON object.

    List places are left out of the path, so equal subfields of a list share one; a list
    in a list is the list of a nameless field. Null values and empty objects and lists
    have no leaf; text that is no JSON object has none. Numbers compare by value.
    """

    def fields(pairs: list) -> dict:
        out = dict(pairs)
        if len(out) < len(pairs):
            raise ValueError("a key stands twice")
        return out

    def constant(name: str):
        raise ValueError(name)

    counts: Counter = Counter()
    try:
        top = json.loads(text or "", parse_float=Decimal, parse_constant=constant, object_pairs_hook=fields)
    except (ValueError, ArithmeticError, RecursionError):
        return counts
    todo = [("", top)] if isinstance(top, dict) else []
    while todo:
        path, held = todo.pop()
        for name, value in held.items():
            below = f"{path}.{name}" if path else name
            for v in value if isinstance(value, list) else (value,):
                if isinstance(v, dict):
                    todo.append((below, v))
                elif isinstance(v, list):
                    todo.append((below, {"": v}))
                elif v is not None:
                    counts[below, v if type(v) in (bool, str) else Decimal(v), type(v) is bool] += 1
    return counts


def field_losses(compacted: DataFrame) -> DataFrame:
    """Per tool and subfield of active results: n (values in the raw text) and lost (values the compact text has not).

    ``compacted`` (conv, pos, role, tool, superseded, content, compact). Values count with
    their number of occurrences: of a value that stands three times and is kept twice, one is lost.
    """
    lost = _losses(compacted, ["tool"])
    return lost.groupBy("tool", F.col("path").alias("field")).agg(F.sum("n").alias("n"), F.sum("lost").alias("lost"))


def subfield_losses(compacted: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """``keys``, conv, pos, tool, path, n, lost: raw and compact leaves of active results compared value by value."""
    own = ["conv", "pos", "tool", *(keys or [])]
    return _losses(compacted, own).groupBy(*own, "path").agg(F.sum("n").alias("n"), F.sum("lost").alias("lost"))


def _losses(compacted: DataFrame, own: list[str]) -> DataFrame:
    """``own``, path, n, lost of each active result. Both texts stand in one row, so they are compared there and no leaf is stored or shuffled."""
    # a result without conversation or place has no compact text to be found by: all its values count as lost
    compact = F.when(F.col("conv").isNotNull() & F.col("pos").isNotNull(), F.col("compact")).alias("compact")
    active = compacted.where((F.col("role") == "tool") & ~F.col("superseded")).select(*own, "content", compact)
    schema = T.StructType([*active.select(*own).schema.fields, T.StructField("path", T.StringType()), T.StructField("n", T.LongType()), T.StructField("lost", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, paths, n, lost = [], [], [], []
            for i, (raw, small) in enumerate(zip(batch.column("content").to_pylist(), batch.column("compact").to_pylist(), strict=True)):
                kept = _leaf_counts(small)
                of: dict[str, list[int]] = {}
                for leaf, count in _leaf_counts(raw).items():
                    sums = of.setdefault(leaf[0], [0, 0])
                    sums[0] += count
                    sums[1] += max(count - kept[leaf], 0)
                at += [i] * len(of)
                paths += of
                n += [x[0] for x in of.values()]
                lost += [x[1] for x in of.values()]
            columns = [batch.column(c).take(pa.array(at, pa.int64())) for c in own]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(paths, pa.string()), pa.array(n, pa.int64()), pa.array(lost, pa.int64())], names=schema.names)

    return active.mapInArrow(run, schema)


def loss_summary(losses: DataFrame, by: str) -> DataFrame:
    """Active results with at least one lost value, and lost values, per ``by`` (tool, path, task …)."""
    hit = losses.where("lost > 0")
    return hit.groupBy(by).agg(F.count_distinct("conv", "pos").alias("results"), F.sum("lost").alias("lost"))

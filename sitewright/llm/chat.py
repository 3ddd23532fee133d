"""Chat formatting by schema fingerprints.

A record is a JSON object in one of several layouts. Of its nested field paths those that any layout knows are
hashed, with a mark on fields whose value has another shape than a text or a list of objects; the hash selects a
declarative mapping to canonical turns (role, text). Fields that no layout knows, such as ids and weights, do not
count. A record whose fingerprint no mapping has, or that is no valid JSON (repeated keys included), has null
turns, is kept, and is formatted as null, so nothing is lost in silence.

The template puts each turn between ``<turn role=...>`` and ``</turn>``. In texts a backslash becomes ``\\b``
and the ``<`` of what looks like a mark becomes ``\\l``; both are undone on reading. The loss mask covers the
texts of the assistant: spans of code points in the formatted string.

Roles stay as they are, but for layouts with names of their own for them. Null texts and roles count as empty.
Turns come in the order of the record; in `packed`, by turn, then role, then text, null first. A conversation
without turns has an empty string and no spans. Records of equal ids are formatted each. Of an empty table the
result is empty. Columns other than those named are not read.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import filled

#: The names that layouts in use give to the same roles.
ALIASES = {"human": "user", "prompter": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant"}


@dataclass(frozen=True)
class Layout:
    """Either a list field with the names of role and text in its elements, or single fields and their roles,
    of which the optional ones may be missing. aliases: whether roles have other names."""

    name: str
    turns: tuple[str, str, str] | None = None
    fields: tuple[tuple[str, str], ...] = ()
    optional: frozenset[str] = field(default_factory=frozenset)
    aliases: bool = False

    def schemas(self) -> list[str]:
        """The paths of each record that the mapping takes, as `paths` writes them."""
        if self.turns:
            rows, role, text = self.turns
            inner = sorted((role, text))
            return [",".join([f"{rows}[]", *(f"{rows}[].{x}" for x in some)]) for some in (inner, [text], [])]
        out: list[list[str]] = [[]]
        for f, _ in sorted(self.fields):
            out = [x + [f] for x in out] + ([x for x in out] if f in self.optional else [])
        return [",".join(x) for x in out if x]


LAYOUTS = (
    Layout("messages", turns=("messages", "role", "content")),
    Layout("conversations", turns=("conversations", "from", "value"), aliases=True),
    Layout("instruction", fields=(("system", "system"), ("instruction", "user"), ("input", "user"), ("output", "assistant")), optional=frozenset({"system", "input"})),
    Layout("prompt", fields=(("system", "system"), ("prompt", "user"), ("response", "assistant")), optional=frozenset({"system"})),
    Layout("completion", fields=(("prompt", "user"), ("completion", "assistant"))),
)


def _at(v: Column, f: str) -> Column:
    return F.try_variant_get(v, f"$.{f}", "variant")


def _nested(v: Column) -> Column:
    return F.schema_of_variant(v).rlike("^(?:ARRAY|OBJECT)")


def _sound(fields: set[str]):
    """Whether an element is an object whose fields are no objects or lists."""
    bad = lambda e: F.exists(F.array(*[F.coalesce(_nested(_at(e, g)), F.lit(False)) for g in sorted(fields)]), lambda x: x)
    return lambda e: F.schema_of_variant(e).startswith("OBJECT") & ~bad(e)


def _has(f: str):
    return lambda e: _at(e, f).isNotNull()


def paths(body: Column, layouts: tuple[Layout, ...] = LAYOUTS) -> Column:
    """The known field paths of a JSON object, in the order of names: ``f`` for a field with a text (or number, or
    null), ``f[]`` for a list of objects and ``f[].g`` for a field of any of them, ``f?`` for another shape. Null if
    it is no JSON."""
    record = F.try_parse_json(body)
    lists: dict[str, set[str]] = {}
    for x in layouts:
        if x.turns:
            lists.setdefault(x.turns[0], set()).update(x.turns[1:])
    out = []
    for f in sorted({f for x in layouts for f, _ in x.fields} | set(lists)):
        value = _at(record, f)
        if f not in lists:
            out.append(F.when(value.isNotNull(), F.when(~_nested(value), F.lit(f)).otherwise(F.lit(f + "?"))))
            continue
        each = F.try_variant_get(record, f"$.{f}", "array<variant>")
        out.append(F.when(value.isNotNull(), F.when(each.isNotNull() & F.forall(each, _sound(lists[f])), F.lit(f + "[]")).otherwise(F.lit(f + "?"))))
        for g in sorted(lists[f]):
            out.append(F.when(F.exists(each, _has(g)), F.lit(f"{f}[].{g}")))
    return F.when(record.isNotNull(), F.array_join(F.filter(F.array(*out), lambda x: x.isNotNull()), ","))


def fingerprint(body: Column, layouts: tuple[Layout, ...] = LAYOUTS) -> Column:
    return F.xxhash64(paths(body, layouts))


def canonical(records: DataFrame, id_col: str = "id", body_col: str = "body", layouts: tuple[Layout, ...] = LAYOUTS) -> DataFrame:
    """id, layout, turns (array of role, text); layout and turns are null where no mapping fits."""
    print_ = F.col("fingerprint")
    layout, turns = F.lit(None).cast("string"), F.lit(None).cast("array<struct<role:string,text:string>>")
    body = F.col("body")
    for x in reversed(layouts):
        fits = print_.isin([_hash(s) for s in x.schemas()])
        if x.turns:
            rows, role, text = x.turns
            read = F.from_json(body, f"`{rows}` array<struct<`{role}`:string,`{text}`:string>>")[rows]
            none = F.array().cast(f"array<struct<`{role}`:string,`{text}`:string>>")
            got = F.transform(F.coalesce(read, none), _turn(role, text, x.aliases))
        else:
            parts = F.from_json(body, ", ".join(f"`{f}` string" for f, _ in x.fields))
            there = F.json_object_keys(body)
            each = [F.when(F.array_contains(there, f), F.struct(F.lit(r).alias("role"), filled(parts[f]).alias("text"))) for f, r in x.fields]
            got = F.filter(F.array(*each), lambda t: t.isNotNull())
        layout, turns = F.when(fits, x.name).otherwise(layout), F.when(fits, got).otherwise(turns)
    rows = records.select(F.col(id_col).alias("id"), F.col(body_col).cast("string").alias("body")).withColumn("fingerprint", fingerprint(F.col("body"), layouts))
    return rows.select("id", layout.alias("layout"), turns.alias("turns"))


def _turn(role: str, text: str, aliases: bool):
    return lambda t: F.struct((_role(t[role]) if aliases else filled(t[role])).alias("role"), filled(t[text]).alias("text"))


def _role(c: Column) -> Column:
    out = filled(c)
    for other, name in ALIASES.items():
        out = F.when(c == other, name).otherwise(out)
    return out


_HASHES: dict[str, int] = {}


def _hash(paths_: str) -> int:
    """Spark's own hash of a constant: evaluated by the optimizer, kept for the process."""
    if paths_ not in _HASHES:
        from pyspark.sql import SparkSession

        _HASHES[paths_] = SparkSession.active().range(1).select(F.xxhash64(F.lit(paths_))).first()[0]
    return _HASHES[paths_]


def escaped(text: Column) -> Column:
    for plain, coded in (("\\", "\\b"), ("<turn", "\\lturn"), ("</turn", "\\l/turn")):
        text = F.replace(text, F.lit(plain), F.lit(coded))
    return text


def plain(text: Column) -> Column:
    for coded, char in (("\\l", "<"), ("\\b", "\\")):
        text = F.replace(text, F.lit(coded), F.lit(char))
    return text


def formatted(turned: DataFrame) -> DataFrame:
    """id, turns to id, formatted, spans (start, length of each text under the loss mask, in code points); both are
    null where turns are. A record's turns are bounded by the record, so no row leaves its place."""
    head = lambda t: F.concat(F.lit("<turn role="), F.url_encode(t["role"]), F.lit(">\n"))
    tail = "</turn>\n"
    pieces = F.transform("turns", lambda t: F.struct(head(t).alias("head"), escaped(t["text"]).alias("body"), (t["role"] == "assistant").alias("loss")))
    laid = turned.select("id", pieces.alias("pieces"))
    empty = F.array().cast("array<struct<start:int,length:int>>")
    start = F.struct(F.lit(1).alias("at"), empty.alias("spans"))

    def step(acc: Column, p: Column) -> Column:
        begin, n = acc["at"] + F.char_length(p["head"]), F.char_length(p["body"])
        span = F.struct(begin.alias("start"), n.alias("length"))
        return F.struct((begin + n + len(tail)).alias("at"), F.when(p["loss"], F.array_append(acc["spans"], span)).otherwise(acc["spans"]).alias("spans"))

    whole = F.array_join(F.transform("pieces", lambda p: F.concat(p["head"], p["body"], F.lit(tail))), "")
    return laid.select("id", whole.alias("formatted"), F.aggregate("pieces", start, step, lambda acc: acc["spans"]).alias("spans"))


def read_back(text: Column) -> Column:
    """The turns of a formatted string, null for null."""
    parts = F.filter(F.split(text, "<turn role="), lambda p: p != "")
    return F.transform(parts, lambda p: F.struct(F.url_decode(F.substring_index(p, ">\n", 1)).alias("role"), plain(p.substr(F.char_length(F.substring_index(p, ">\n", 1)) + 3, F.char_length(p) - F.char_length(F.substring_index(p, ">\n", 1)) - 10)).alias("text")))


def masked(text: Column, spans: Column) -> Column:
    """All text under the loss mask, unescaped, nothing between."""
    return F.array_join(F.transform(spans, lambda s: plain(text.substr(s["start"], s["length"]))), "")


def packed(rows: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """Rows of turns to one JSON record each (id, body): a single exchange as a prompt record, one under a
    system text as an instruction record, anything else as messages."""
    turn = F.struct(F.col(turn_col).alias("turn"), filled(F.col(role_col).cast("string")).alias("role"), filled(F.col(text_col).cast("string")).alias("content"))
    conv = rows.groupBy(F.col(id_col).alias("id")).agg(F.array_sort(F.collect_list(turn)).alias("t"))
    roles, text = F.transform("t", lambda t: t["role"]), lambda i: F.get("t", F.lit(i))["content"]
    is_ = lambda *r: roles == F.array(*map(F.lit, r))
    body = (
        F.when(is_("user", "assistant"), F.to_json(F.struct(text(0).alias("prompt"), text(1).alias("response"))))
        .when(is_("system", "user", "assistant"), F.to_json(F.struct(text(0).alias("system"), text(1).alias("instruction"), text(2).alias("output"))))
        .otherwise(F.to_json(F.struct(F.transform("t", lambda t: F.struct(t["role"].alias("role"), t["content"].alias("content"))).alias("messages"))))
    )
    return conv.select("id", body.alias("body"))

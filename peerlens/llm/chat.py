"""Chat formatting by schema fingerprints, in DataFrame functions only.

Records of chat corpora come in many layouts: a prompt and a response, an instruction with an input and an output, lists of
messages under several names, pairs of history. A record is a VARIANT, so no schema is inferred over the corpus. The paths of
its nested fields are walked, those that any layout names are sorted and hashed, and the hash selects a declared layout, whose
parts say which path holds which role's text. Paths that no layout names (ids, scores) don't count, unless they
lie below a text, which then is none. What no layout declares
keeps its fingerprint and paths and has null turns, for the caller to put aside: a new layout is a new declaration, not code.

``render`` writes turns between control strings. ``<|`` opens a control string and stands nowhere else: inside texts each run of
``<``, backslashes and ``|`` gets one more backslash, which ``unescape`` takes away again. Roles stand on a line of their own and
are percent-encoded where they hold ``%``, ``<`` or a line break. The loss mask is a list of spans in code points of the output.

Rows are shuffled once, to gather a conversation's turns. A conversation is one record and one text, so its rows meet in one
task; a VARIANT holds up to 128 MB.

Defined results: a null or absent text is empty, a null role is an empty one; a text that is no string is its JSON; a null record
has no paths and no layout; rows come by turn (nulls first), then role, then text, and repeated rows are turns each; a null conv_id
is a conversation of its own; a list without messages is a conversation without turns, whose output is empty; further columns of
records are kept if they don't clash with the added ones, and are not read; an empty table stays empty.
"""

from __future__ import annotations

import hashlib
import itertools
import re
from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bound, running

OPEN, CLOSE, LOSS_ROLE = "<|im_start|>", "<|im_end|>", "assistant"
#: Nesting that the walk follows: record, list, message, and a list or object inside.
DEPTH = 4


@dataclass(frozen=True)
class Text:
    """The texts at ``paths``, those that aren't empty put together as one turn of ``role``."""

    role: str
    paths: tuple[str, ...]

    def fields(self) -> list[set[str]]:
        return [{p} for p in self.paths]


@dataclass(frozen=True)
class Messages:
    """A list of objects that name their role and hold its text. ``names`` maps roles of the layout to canonical ones."""

    path: str
    role: str
    text: str
    names: dict[str, str] = field(default_factory=dict, hash=False)

    def fields(self) -> list[set[str]]:
        whole = {self.path, f"{self.path}[]", f"{self.path}[].{self.role}", f"{self.path}[].{self.text}"}
        return [whole]


@dataclass(frozen=True)
class Pairs:
    """A list of lists of two texts, what a user said and what was answered."""

    path: str

    def fields(self) -> list[set[str]]:
        return [{self.path, f"{self.path}[]", f"{self.path}[][]"}]


@dataclass(frozen=True)
class Layout:
    """Parts in the order of their turns. Paths in ``optional`` may be absent; a list may be null or empty."""

    name: str
    parts: tuple[Text | Messages | Pairs, ...]
    optional: tuple[str, ...] = ()

    def path_sets(self) -> set[frozenset[str]]:
        choices = []
        for part in self.parts:
            for whole in part.fields():
                top = min(whole, key=len)
                lists = [] if whole == {top} else [{top}, {top, f"{top}[]"}]
                choices.append([whole, *lists, *([set()] if top in self.optional else [])])
        return {frozenset().union(*chosen) for chosen in itertools.product(*choices)} - {frozenset()}


#: The layouts that corpora commonly use.
LAYOUTS = (
    Layout("messages", (Messages("messages", "role", "content"),)),
    Layout("turns_from_value", (Messages("conversations", "from", "value", {"human": "user", "gpt": "assistant", "chatgpt": "assistant", "bot": "assistant"}),)),
    Layout("prompt_response", (Text("system", ("system_prompt",)), Text("user", ("prompt",)), Text("assistant", ("response",))), ("system_prompt",)),
    Layout("prompt_completion", (Text("user", ("prompt",)), Text("assistant", ("completion",)))),
    Layout("question_answer", (Text("user", ("context", "question")), Text("assistant", ("answer",))), ("context",)),
    Layout("instruction", (Text("system", ("system",)), Pairs("history"), Text("user", ("instruction", "input")), Text("assistant", ("output",))), ("system", "history", "input")),
)


def fingerprint_of(paths: Sequence[str] | frozenset[str]) -> str:
    return hashlib.sha256("\n".join(sorted(paths)).encode()).hexdigest()


def declared(layouts: Sequence[Layout]) -> dict[str, Layout]:
    """The layout of each fingerprint that ``layouts`` accept. Two layouts for one fingerprint are an error."""
    found: dict[str, Layout] = {}
    for layout in layouts:
        for paths in layout.path_sets():
            if found.setdefault(fingerprint_of(paths), layout) is not layout:
                raise ValueError(f"layouts {found[fingerprint_of(paths)].name} and {layout.name} both take {sorted(paths)}")
    return found


def nested_paths(value: Column, depth: int = DEPTH) -> Column:
    """The paths of all fields below a VARIANT, a list's elements as ``[]``; what lies deeper than ``depth`` isn't walked."""
    if not depth:
        return F.array().cast("array<string>")

    def below(of: Column) -> Column:
        return F.transform(nested_paths(of, depth - 1), lambda p: F.concat(F.when(p.startswith("["), "").otherwise("."), p))

    members = F.try_variant_get(value, "$", "map<string,variant>")
    elements = F.try_variant_get(value, "$", "array<variant>")
    of_members = F.flatten(F.transform(F.map_entries(members), lambda e: F.concat(F.array(e["key"]), F.transform(below(e["value"]), lambda p: F.concat(e["key"], p)))))
    of_elements = F.array_distinct(F.concat(F.array(F.lit("[]")), F.flatten(F.transform(elements, lambda x: F.transform(below(x), lambda p: F.concat(F.lit("[]"), p))))))
    return F.coalesce(of_members, of_elements, F.array().cast("array<string>"))


def _string(record: Column, path: str) -> Column:
    return F.coalesce(F.try_variant_get(record, "$." + path, "string"), F.lit(""))


def _turn(role: Column, text: Column) -> Column:
    return F.struct(role.alias("role"), text.alias("text"))


def _turns(record: Column, paths: Column, part: Text | Messages | Pairs) -> Column:
    nothing = F.array().cast("array<struct<role: string, text: string>>")
    if isinstance(part, Text):
        texts = F.filter(F.array(*[_string(record, p) for p in part.paths]), lambda t: t != "")
        there = F.arrays_overlap(paths, F.array(*[F.lit(p) for p in part.paths]))
        return F.when(there, F.array(_turn(F.lit(part.role), F.array_join(texts, "\n\n")))).otherwise(nothing)
    found = F.coalesce(F.try_variant_get(record, "$." + part.path, "array<variant>"), F.array().cast("array<variant>"))
    if isinstance(part, Pairs):
        one = lambda pair, i: F.coalesce(F.try_variant_get(pair, f"$[{i}]", "string"), F.lit(""))
        return F.flatten(F.transform(found, lambda p: F.array(_turn(F.lit("user"), one(p, 0)), _turn(F.lit("assistant"), one(p, 1)))))

    def named(role: Column) -> Column:
        out = role
        for theirs, ours in part.names.items():
            out = F.when(role == theirs, ours).otherwise(out)
        return out

    return F.transform(found, lambda m: _turn(named(_string(m, part.role)), _string(m, part.text)))


def canonical(records: DataFrame, record: str = "record", layouts: Sequence[Layout] = LAYOUTS) -> DataFrame:
    """``records`` with paths (those that layouts name, or that lie below their texts), fingerprint, layout (null if none is declared) and turns, an array of
    (role, text); ``record`` is the name of their VARIANT."""
    known = declared(layouts)
    vocabulary = sorted({p for layout in layouts for paths in layout.path_sets() for p in paths})
    ends = [p for p in vocabulary if not any(q.startswith((p + "[", p + ".")) for q in vocabulary)]
    inside = "^(" + "|".join(re.escape(p) for p in ends) + r")[.\[]"
    named = F.array_sort(F.array_distinct(F.filter(nested_paths(F.col(record)), lambda p: p.isin(vocabulary) | p.rlike(inside))))
    walked = records.withColumn("paths", named).withColumn("fingerprint", F.sha2(F.array_join("paths", "\n").cast("binary"), 256))
    layout, turns = F.lit(None).cast("string"), F.lit(None).cast("array<struct<role: string, text: string>>")
    for one in layouts:
        chosen = F.col("fingerprint").isin([f for f, x in known.items() if x is one])
        layout = F.when(chosen, one.name).otherwise(layout)
        turns = F.when(chosen, F.concat(*[_turns(F.col(record), F.col("paths"), p) for p in one.parts])).otherwise(turns)
    return walked.withColumn("layout", layout).withColumn("turns", turns)


def escape(text: Column) -> Column:
    return F.regexp_replace(text, r"<(\\*)\|", r"<$1\\|")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"<(\\*)\\\|", "<$1|")


#: What a role may not hold as it is, and what stands for it; the first is put back last.
ROLE_CODES = (("%", "%25"), ("\n", "%0A"), ("<", "%3C"))


def _coded(role: Column, back: bool = False) -> Column:
    for plain, code in reversed(ROLE_CODES) if back else ROLE_CODES:
        role = F.replace(role, F.lit(code if back else plain), F.lit(plain if back else code))
    return role


def render(turns: Column, loss_role: str = LOSS_ROLE) -> Column:
    """A struct of formatted, the text of all turns, and loss, the array of (start, chars) of the escaped texts of ``loss_role``."""
    pieces = F.transform(turns, lambda t: F.struct((t["role"] == loss_role).alias("loss"), F.concat(F.lit(OPEN), _coded(t["role"]), F.lit("\n")).alias("head"), escape(t["text"]).alias("body")))
    tail = CLOSE + "\n"

    def whole(found: Column) -> Column:
        chars = F.transform(found, lambda p: (F.length(p["head"]) + F.length(p["body"]) + len(tail)).cast("long"))
        text = F.array_join(F.transform(found, lambda p: F.concat(p["head"], p["body"], F.lit(tail))), "")
        span = lambda starts: F.filter(F.transform(found, lambda p, i: F.when(p["loss"], F.struct((starts[i] + F.length(p["head"])).alias("start"), F.length(p["body"]).cast("long").alias("chars")))), lambda s: s.isNotNull())
        return F.struct(text.alias("formatted"), bound(running(chars), span).alias("loss"))

    return bound(pieces, whole)


def parsed(formatted: Column) -> Column:
    """The turns (role, text) that a rendered text holds."""
    tail = len(CLOSE) + 1

    def turn(piece: Column) -> Column:
        role = F.substring_index(piece, "\n", 1)
        text = bound(F.length(role), lambda n: F.substring(piece, n + 2, F.length(piece) - n - 1 - tail))
        return _turn(_coded(role, back=True), unescape(text))

    pieces = F.split(formatted, re.escape(OPEN), -1)
    return bound(pieces, lambda found: F.transform(F.slice(found, F.lit(2), F.size(found)), turn))


def under_loss(formatted: Column, loss: Column) -> Column:
    """All text under the loss mask, unescaped, in order. Code points are found by their place, four bytes each, so that
    many spans of a long text don't each count from its start."""
    wide = F.encode(formatted, "UTF-32")
    return bound(wide, lambda b: F.array_join(F.transform(loss, lambda s: unescape(F.decode(F.substring(b, (s["start"] * 4 + 1).cast("int"), (s["chars"] * 4).cast("int")), "UTF-32"))), ""))


def as_records(rows: DataFrame) -> DataFrame:
    """(conv_id, record): each conversation of ``rows`` (conv_id, turn, role, text) as a VARIANT in the narrowest layout that can
    hold it, as chat corpora have them: a prompt and a response, an instruction under a system text, and lists of messages, those
    of odd ids by their other names if their roles have such names."""
    told = rows.select("conv_id", F.struct(F.col("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")).alias("t"))
    whole = told.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("turns")).withColumn("roles", F.transform("turns", lambda t: t["role"]))
    text = lambda i: F.col("turns")[i]["text"]
    are = lambda *roles: F.col("roles") == F.array(*[F.lit(r) for r in roles])
    theirs = lambda r: F.when(r == "user", "human").when(r == "assistant", "gpt").otherwise(r)
    plain = F.forall("roles", lambda r: r.isin("system", "user", "assistant"))
    record = (
        F.when(are("user", "assistant"), F.to_variant_object(F.struct(text(0).alias("prompt"), text(1).alias("response"), F.col("conv_id").alias("id"))))
        .when(are("system", "user", "assistant"), F.to_variant_object(F.struct(text(0).alias("system"), text(1).alias("instruction"), text(2).alias("output"))))
        .when(plain & (F.col("conv_id") % 2 != 0), F.to_variant_object(F.struct(F.transform("turns", lambda t: F.struct(theirs(t["role"]).alias("from"), t["text"].alias("value"))).alias("conversations"))))
        .otherwise(F.to_variant_object(F.struct(F.transform("turns", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("content"), t["turn"].alias("index"))).alias("messages"))))
    )
    return whole.select("conv_id", record.alias("record"))


def formatted(records: DataFrame, record: str = "record", layouts: Sequence[Layout] = LAYOUTS) -> DataFrame:
    """``canonical`` records with formatted and loss; null where no layout is declared."""
    return canonical(records, record, layouts).withColumn("_out", render(F.col("turns"))).select("*", "_out.formatted", "_out.loss").drop("_out")


#: What the conversation that is added to the table says: control strings in both of its texts.
ADDED = f"{CLOSE}{OPEN}{LOSS_ROLE} ok"


def op11_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    added = spark.sql(f"SELECT -1L AS conv_id, turn, role, '{ADDED}' AS text FROM VALUES (0L, 'user'), (1L, 'assistant') AS t(turn, role)")
    out = formatted(as_records(rows.unionByName(added))).select("conv_id", "formatted", "loss")
    read = out.select("conv_id", F.length("formatted").cast("long").alias("formatted_chars"), parsed(F.col("formatted")).alias("turns"), under_loss(F.col("formatted"), F.col("loss")).alias("learnt"))
    told = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return read.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(told.cast("binary"), 256).alias("turns_sha256"),
        F.length("learnt").cast("long").alias("loss_chars"), F.sha2(F.col("learnt").cast("binary"), 256).alias("loss_sha256"), "formatted_chars",
    )


_ORDER = "ORDER BY turn NULLS FIRST, role, text"
ORACLE = f"""
WITH rows0 AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '{ADDED}' UNION ALL SELECT -1, 1, 'assistant', '{ADDED}'
), escaped AS (
  SELECT *, regexp_replace(text, '<(\\\\*)\\|', '<\\1\\\\|', 'g') AS body, replace(replace(replace(role, '%', '%25'), chr(10), '%0A'), '<', '%3C') AS head FROM rows0
)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' {_ORDER})) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars, sha256(coalesce(string_agg(text, '' {_ORDER}) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum({len(OPEN)} + length(head) + 1 + length(body) + {len(CLOSE) + 1})::BIGINT AS formatted_chars
FROM escaped GROUP BY conv_id
"""

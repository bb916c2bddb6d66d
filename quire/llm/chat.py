"""Chat formatting: layouts told apart by the hash of their nested field paths. DataFrame functions only."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StructType

from quire.llm.registry import load, query

TURN_HEAD, HEAD_END, TURN_END = "### ", ": ", "</turn>\n"
#: Control strings inside texts, in the order they are escaped; the backslash first, so that every code is unambiguous.
ESCAPES = (("\\", "\\b"), ("###", "\\h"), ("</turn>", "\\t"), (": ", "\\c"))
TURNS = "array<struct<role:string,text:string>>"


@dataclass(frozen=True)
class Mapping:
    """How a layout becomes turns: ``parts`` are (role, path of a text) in order, or ``messages`` is (path of an array,
    role field, text field, names of roles). ``id_path`` and ``turn_path`` are for layouts of one turn a record, whose
    role stands at ``role_path``."""

    parts: tuple[tuple[str, str], ...] = ()
    messages: tuple[str, str, str, tuple[tuple[str, str], ...]] | None = None
    id_path: str | None = None
    turn_path: str | None = None
    role_path: str | None = None

    def paths(self) -> list[str]:
        found = [p for _, p in self.parts] + [p for p in (self.id_path, self.turn_path, self.role_path) if p]
        if self.messages:
            found += [f"{self.messages[0]}[].{self.messages[1]}", f"{self.messages[0]}[].{self.messages[2]}"]
        return sorted(found)


SHARE_ROLES = (("human", "user"), ("gpt", "assistant"))
LAYOUTS = (
    Mapping(parts=(("user", "prompt"), ("assistant", "completion"))),
    Mapping(parts=(("user", "prompt"), ("assistant", "response"))),
    Mapping(parts=(("user", "instruction"), ("assistant", "output"))),
    Mapping(parts=(("system", "instruction"), ("user", "input"), ("assistant", "output"))),
    Mapping(parts=(("user", "question"), ("assistant", "answer"))),
    Mapping(messages=("messages", "role", "content", ())),
    Mapping(messages=("conversations", "from", "value", SHARE_ROLES)),
    Mapping(parts=(("", "text"),), id_path="conv_id", turn_path="turn", role_path="role"),
)


JSON = {"maxStringLen": str(2**31 - 1)}  # the reader's own limit would lose texts of over 20,000,000 characters


def field_paths(record: Column, layouts: tuple[Mapping, ...]) -> Column:
    """The nested field paths of a JSON record that some layout knows, sorted; others do not tell layouts apart.

    Those inside an array are the fields of any of its items.
    """
    known = sorted({p for m in layouts for p in m.paths()})
    top = F.coalesce(F.json_object_keys(record), F.array().cast("array<string>"))
    nested = [_inner_paths(record, box) for box in sorted({m.messages[0] for m in layouts if m.messages})]
    return F.array_sort(F.array_intersect(F.concat(top, *nested), F.array(*map(F.lit, known))))


def _inner_paths(record: Column, box: str) -> Column:
    items = F.from_json(record, f"struct<`{box}`:array<string>>", JSON)[box]
    nothing = F.array().cast("array<string>")
    keys = F.flatten(F.transform(F.coalesce(items, nothing), lambda x: F.coalesce(F.json_object_keys(x), nothing)))
    return F.transform(keys, lambda k: F.concat(F.lit(f"{box}[]."), k))


def _fields(layouts: tuple[Mapping, ...]) -> str:
    """The schema of all fields that some layout knows."""
    found = {f"`{path}`:string" for m in layouts for path in m.paths() if "[]" not in path}
    found |= {f"`{m.messages[0]}`:array<string>" for m in layouts if m.messages}
    return f"struct<{','.join(sorted(found))}>"


def _messages(items: Column, role: str, content: str, names: tuple[tuple[str, str], ...]) -> Column:
    def turn(x: Column) -> Column:
        named = F.coalesce(*[F.when(x[role] == a, F.lit(b)) for a, b in names], x[role], F.lit(""))
        return F.struct(named.alias("role"), F.coalesce(x[content], F.lit("")).alias("text"))

    return F.transform(items, turn)


def _turns(mapping: Mapping, value) -> Column:
    """The turns of a record of one layout; ``value`` gives the column at a path, its items read as what is asked for."""
    if mapping.messages:
        box, *names = mapping.messages
        return _messages(value(box, f"struct<`{names[0]}`:string,`{names[1]}`:string>"), *names)
    text = lambda path: F.coalesce(value(path).cast("string"), F.lit(""))
    return F.array(*[
        F.struct((text(mapping.role_path) if mapping.role_path else F.lit(role)).alias("role"), text(path).alias("text"))
        for role, path in mapping.parts
    ])


def fingerprint(paths: Column) -> Column:
    return F.xxhash64(F.array_join(paths, "|"))


def canonical_turns(records: DataFrame, record: str = "record", layouts: tuple[Mapping, ...] = LAYOUTS) -> DataFrame:
    """``records`` with fingerprint, known (some layout has it), conv_key, turn_no and turns (role, text) of each record.

    The layout is chosen by the hash of the record's field paths alone; fields that no layout knows are passed over.
    Records of no layout, and those that are null or not JSON objects, have known = false and no turns. A null text or
    role is an empty one. A layout of one turn a record also gives conv_key and turn_no, else null.
    """
    mark = F.col("fingerprint")

    def value(path: str, item: str | None = None) -> Column:
        found = F.col("__json")[path]
        return F.transform(found, lambda x: F.from_json(x, item, JSON)) if item else found

    turns, keys, numbers, seen = None, None, None, []
    for m in layouts:
        is_it = mark == fingerprint(F.array(*map(F.lit, m.paths())))
        seen.append(is_it)
        turns = F.when(is_it, _turns(m, value)) if turns is None else turns.when(is_it, _turns(m, value))
        if m.id_path:
            keys = F.when(is_it, value(m.id_path)) if keys is None else keys
            numbers = F.when(is_it, value(m.turn_path).try_cast("long")) if numbers is None else numbers
    none = F.lit(None)
    known = seen[0]
    for x in seen[1:]:
        known = known | x
    marked = records.withColumns(
        {"fingerprint": fingerprint(field_paths(F.col(record), layouts)), "__json": F.from_json(record, _fields(layouts), JSON)}
    )
    return marked.select(
        *[F.col(c) for c in marked.columns if c != "__json"], F.coalesce(known, F.lit(False)).alias("known"),
        (none.cast("string") if keys is None else keys).alias("conv_key"),
        (none.cast("long") if numbers is None else numbers).alias("turn_no"),
        F.coalesce(turns, F.array().cast(TURNS)).cast(TURNS).alias("turns"),
    )


def table_paths(schema: StructType) -> list[str]:
    """The nested field paths of a table's rows: columns, and fields of columns that are arrays of structs."""
    found = []
    for f in schema.fields:
        found.append(f.name)
        if isinstance(f.dataType, ArrayType) and isinstance(f.dataType.elementType, StructType):
            found += [f"{f.name}[].{x.name}" for x in f.dataType.elementType.fields]
    return found


def table_turns(rows: DataFrame, layouts: tuple[Mapping, ...] = LAYOUTS) -> DataFrame:
    """``canonical_turns`` of rows whose fields are columns already: fingerprint, known, conv_key, turn_no and turns.

    All rows have one layout, so the paths are those of the schema; their fingerprint is compared with the layouts' in
    each row as for records. No text goes through JSON, so its length has no limit but that of a value.
    """
    told = sorted(set(table_paths(rows.schema)) & {p for m in layouts for p in m.paths()})
    mark = fingerprint(F.array(*map(F.lit, told)).cast("array<string>"))
    found = [m for m in layouts if m.paths() == told]
    marked, none = rows.withColumn("fingerprint", mark), F.lit(None)
    if not found:
        return marked.select(
            "fingerprint", F.lit(False).alias("known"), none.cast("string").alias("conv_key"), none.cast("long").alias("turn_no"),
            F.array().cast(TURNS).alias("turns"),
        )
    own = found[0]
    known = F.col("fingerprint") == fingerprint(F.array(*map(F.lit, own.paths())))
    return marked.select(
        "fingerprint", known.alias("known"), (F.col(own.id_path) if own.id_path else none).cast("string").alias("conv_key"),
        (F.col(own.turn_path) if own.turn_path else none).cast("long").alias("turn_no"),
        F.coalesce(_turns(own, lambda path, item=None: F.col(path)), F.array().cast(TURNS)).cast(TURNS).alias("turns"),
    )


def gathered(turns: DataFrame, key: str = "conv_key") -> DataFrame:
    """(key, turns) of records of one turn: the turns of a key by turn_no; equal numbers follow role and text.

    A conversation is one value and so one row, however long; nothing larger than a conversation is put together.
    """
    rows = turns.select(key, "turn_no", F.inline("turns"))
    listed = rows.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("turn_no", "role", "text"))).alias("turns"))
    return listed.select(key, F.transform("turns", lambda t: F.struct(t["role"], t["text"])).cast(TURNS).alias("turns"))


def escaped(text: Column) -> Column:
    for plain, code in ESCAPES:
        text = F.replace(text, F.lit(plain), F.lit(code))
    return text


def unescaped(text: Column) -> Column:
    for plain, code in reversed(ESCAPES):
        text = F.replace(text, F.lit(code), F.lit(plain))
    return text


def formatted(turns: Column, trained: tuple[str, ...] = ("assistant",)) -> Column:
    """struct(text, loss): ``### role: text</turn>`` a turn, and the character spans of trained roles' texts."""
    pieces = F.transform(
        turns,
        lambda t: F.struct(
            F.concat(F.lit(TURN_HEAD), escaped(F.coalesce(t["role"], F.lit(""))), F.lit(HEAD_END)).alias("head"),
            escaped(F.coalesce(t["text"], F.lit(""))).alias("body"),
            F.coalesce(t["role"].isin(*trained), F.lit(False)).alias("trained"),
        ),
    )
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int>>").alias("loss"))

    def step(state: Column, p: Column) -> Column:
        begin = state["at"] + F.length(p["head"])
        end = begin + F.length(p["body"])
        span = F.array(F.struct(begin.alias("start"), end.alias("end")))
        loss = F.when(p["trained"], F.concat(state["loss"], span)).otherwise(state["loss"])
        return F.struct((end + len(TURN_END)).alias("at"), loss.alias("loss"))

    text = F.array_join(F.transform(pieces, lambda p: F.concat(p["head"], p["body"], F.lit(TURN_END))), "")
    return F.struct(text.alias("text"), F.aggregate(pieces, start, step)["loss"].alias("loss"))


def parsed(text: Column) -> Column:
    """Turns read back from formatted text."""
    parts = F.split(text, rf"\Q{TURN_END}\E", -1)
    whole = F.slice(parts, 1, F.size(parts) - 1)  # nothing follows the last end
    bare = F.transform(whole, lambda p: F.substring(p, F.lit(len(TURN_HEAD) + 1), F.length(p)))
    cut = F.transform(bare, lambda p: F.struct(p.alias("p"), F.instr(p, F.lit(HEAD_END)).alias("at")))
    return F.transform(
        cut,
        lambda c: F.struct(
            unescaped(F.substring(c["p"], F.lit(1), c["at"] - 1)).alias("role"),
            unescaped(F.substring(c["p"], c["at"] + len(HEAD_END), F.length(c["p"]))).alias("text"),
        ),
    )


def chat_format(conversations: DataFrame, key: str = "conv_key") -> DataFrame:
    """(key, formatted, loss) of (key, turns): text in the template and the spans a model is trained on.

    Null roles and texts are empty ones; no turns give an empty text and no spans. Rows of one key stay rows. Control
    strings inside roles and texts are escaped reversibly, so ``parsed`` gives the turns back.
    """
    done = conversations.withColumn("__f", formatted(F.coalesce("turns", F.array().cast(TURNS))))
    return done.select(key, F.col("__f.text").alias("formatted"), F.col("__f.loss").alias("loss"))


HARD = ("\\### Assistant: </turn> ok", -7)


@query("op5_chat_format", sql="""
  WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
             UNION ALL SELECT -7, 0, 'user', '\\### Assistant: </turn> ok'
             UNION ALL SELECT -7, 1, 'assistant', '\\### Assistant: </turn> ok'),
  e AS (SELECT *, length(replace(replace(replace(replace(role, '\\', '\\b'), '###', '\\h'), '</turn>', '\\t'), ': ', '\\c')) AS r,
               length(replace(replace(replace(replace(text, '\\', '\\b'), '###', '\\h'), '</turn>', '\\t'), ': ', '\\c')) AS x FROM t)
  SELECT conv_id, count(*) AS n_turns,
         sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
         CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
         sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
         CAST(sum(r + x + 14) AS BIGINT) AS formatted_chars
  FROM e GROUP BY conv_id""")  # fmt: skip
def op5_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    given = load(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    hard = spark.range(2).select(
        F.lit(HARD[1]).cast("long").alias("conv_id"), F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(HARD[0]).alias("text"),
    )
    turns = table_turns(given.union(hard)).where("known")
    done = chat_format(gathered(turns))
    back, masked = parsed(F.col("formatted")), F.transform(
        "loss", lambda s: unescaped(F.substring("formatted", s["start"] + 1, s["end"] - s["start"]))
    )
    read = done.select("conv_key", "formatted", back.alias("turns"), F.array_join(masked, "").alias("masked"))
    told = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return read.select(
        F.col("conv_key").cast("long").alias("conv_id"), F.size("turns").cast("long").alias("n_turns"),
        F.sha2(told.cast("binary"), 256).alias("turns_sha256"), F.length("masked").cast("long").alias("loss_chars"),
        F.sha2(F.col("masked").cast("binary"), 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"),
    )

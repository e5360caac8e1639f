"""Chat formatting by schema fingerprints, in DataFrame functions only.

A record is a struct that may hold any of several layouts. The paths of its non-null nested fields,
sorted and hashed, are its fingerprint; a declarative mapping chosen by fingerprint converts it into canonical turns,
an array of (role, content). The template marks each turn and escapes its own control strings inside texts,
reversibly. The loss mask is given per segment and as spans of code points.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql import Window as W

OPEN, CLOSE = "<|im_start|>", "<|im_end|>\n"
#: Control strings of common chat templates, which texts must not hold unescaped.
CONTROL = r"\|im_start\|>|\|im_end\|>|s>|/s>|\|endoftext\|>|<SYS>>|</SYS>>|INST\]|/INST\]"
TURNS = "array<struct<role:string,content:string>>"
#: Layouts: paths that are set, and the canonical turns as SQL over the fields of `record`.
LAYOUTS: Mapping[tuple[str, ...], str] = {
    ("messages[].content", "messages[].role"): "transform(record.messages, m -> struct(m.role as role, coalesce(m.content, '') as content))",
    ("conversations[].from", "conversations[].value"): "transform(record.conversations, m -> struct(case m.`from` when 'human' then 'user' when 'gpt' then 'assistant' else m.`from` end as role, coalesce(m.value, '') as content))",
    ("prompt", "response"): "array(struct('user' as role, record.prompt as content), struct('assistant' as role, record.response as content))",
    ("prompt", "response", "system"): "array(struct('system' as role, record.system as content), struct('user' as role, record.prompt as content), struct('assistant' as role, record.response as content))",
    ("instruction", "output"): "array(struct('user' as role, record.instruction as content), struct('assistant' as role, record.output as content))",
    ("input", "instruction", "output"): "array(struct('user' as role, concat(record.instruction, '\n\n', record.input) as content), struct('assistant' as role, record.output as content))",
}
#: The fields of all layouts; JSON lines read with it fit `format_records`.
RECORD = "struct<messages:array<struct<role:string,content:string>>,conversations:array<struct<`from`:string,value:string>>,prompt:string,response:string,system:string,instruction:string,input:string,output:string>"


def fingerprint(record: str = "record") -> Column:
    """Hash of the sorted paths that are set; an array's fields count if it is not null."""
    array = lambda name, fields: [F.when(F.col(f"{record}.{name}").isNotNull(), F.lit(f"{name}[].{f}")) for f in fields]
    plain = [F.when(F.col(f"{record}.{name}").isNotNull(), F.lit(name)) for name in ("prompt", "response", "system", "instruction", "input", "output")]
    paths = F.array_compact(F.array(*array("messages", ("role", "content")), *array("conversations", ("from", "value")), *plain))
    return F.md5(F.array_join(F.array_sort(paths), "\n").cast("binary"))


def canonical(records: DataFrame) -> DataFrame:
    """Adds fingerprint and turns; turns is null for a layout without a mapping."""
    out = F.lit(None).cast(TURNS)
    for paths, mapping in LAYOUTS.items():
        out = F.when(F.col("fingerprint") == F.md5(F.lit("\n".join(sorted(paths))).cast("binary")), F.expr(mapping).cast(TURNS)).otherwise(out)
    return records.withColumn("fingerprint", fingerprint()).withColumn("turns", out)


def escaped(text: Column) -> Column:
    """A backslash more after the first character of each control string."""
    return F.regexp_replace(text, rf"([<\[])(\\*)(?={CONTROL})", r"$1$2\\")


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, rf"([<\[])(\\*)\\(?={CONTROL})", r"$1$2")


def role_written(role: Column) -> Column:
    """A role on one line: its control strings escaped, then backslashes and line breaks."""
    out = F.replace(escaped(role), F.lit("\\"), F.lit("\\\\"))
    return F.replace(F.replace(out, F.lit("\n"), F.lit("\\n")), F.lit("\r"), F.lit("\\r"))


def role_read(role: Column) -> Column:
    parts = F.regexp_extract_all(role, F.lit(r"(?s)(\\.|[^\\]+)"), F.lit(1))
    plain = F.array_join(F.transform(parts, lambda p: F.when(p == "\\n", "\n").when(p == "\\r", "\r").when(p == "\\\\", "\\").otherwise(p)), "")
    return unescaped(F.when(F.instr(role, "\\") > 0, plain).otherwise(role))


def format_records(records: DataFrame, key: str = "conv_id") -> DataFrame:
    """Per record: key, fingerprint, formatted, segments (text, loss) that make it up, and loss_spans (start, end; end exclusive).

    A null content is an empty text, a null role an empty name. Records of an unknown layout come back with null in all
    but key and fingerprint, those without turns with an empty text. Records need distinct keys. Extra columns are ignored.
    """
    x = canonical(records.select(key, "record")).select(key, "fingerprint", "turns")
    t = x.select(key, "fingerprint", F.col("turns").isNull().alias("_unknown"), F.posexplode_outer("turns").alias("_pos", "_turn"))
    role = role_written(F.coalesce(F.col("_turn.role"), F.lit("")))
    t = t.withColumns({"_head": F.when(F.col("_pos").isNull(), "").otherwise(F.concat(F.lit(OPEN), role, F.lit("\n"))), "_text": F.when(F.col("_pos").isNull(), "").otherwise(escaped(F.coalesce(F.col("_turn.content"), F.lit("")))), "_foot": F.when(F.col("_pos").isNull(), "").otherwise(CLOSE), "_loss": F.coalesce(F.col("_turn.role") == "assistant", F.lit(False))})
    so_far = F.sum(F.length("_head") + F.length("_text") + F.length("_foot")).over(W.partitionBy(key).orderBy("_pos"))
    t = t.withColumn("_end", so_far - F.length("_foot")).withColumn("_start", F.col("_end") - F.length("_text"))
    rows = F.array_sort(F.collect_list(F.struct("_pos", "_head", "_text", "_foot", "_loss", "_start", "_end")))
    g = t.groupBy(key).agg(F.first("fingerprint").alias("fingerprint"), F.max("_unknown").alias("_unknown"), rows.alias("_rows"))
    segments = F.flatten(F.transform("_rows", lambda r: F.array(F.struct(r._head.alias("text"), F.lit(False).alias("loss")), F.struct(r._text.alias("text"), r._loss.alias("loss")), F.struct(r._foot.alias("text"), F.lit(False).alias("loss")))))
    spans = F.transform(F.filter("_rows", lambda r: r._loss), lambda r: F.struct(r._start.alias("start"), r._end.alias("end")))
    known = lambda c: F.when(~F.col("_unknown"), c)
    g = g.withColumn("_segments", segments)
    return g.select(key, "fingerprint", known(F.array_join(F.transform("_segments", lambda s: s.text), "")).alias("formatted"), known(F.col("_segments")).alias("segments"), known(spans).alias("loss_spans"))


def parse_formatted(formatted: Column) -> Column:
    """The turns of a formatted text, unescaped."""
    pieces = F.filter(F.split(formatted, r"<\|im_start\|>", -1), lambda _, i: i > 0)
    def turn(p: Column) -> Column:
        cut = F.instr(p, "\n")
        return F.struct(role_read(F.substring(p, F.lit(1), cut - 1)).alias("role"), unescaped(F.substring(p, cut + 1, F.length(p) - cut - len(CLOSE))).alias("content"))
    return F.transform(pieces, turn)


def turns_to_records(conversations: DataFrame) -> DataFrame:
    """Rows by turn (conv_id, turn, role, text) to one record of the messages layout per conversation; equal turns are ordered by role, then text."""
    turn = F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("content"))
    g = conversations.groupBy("conv_id").agg(F.array_sort(F.collect_list(turn)).alias("_turns"))
    messages = F.transform("_turns", lambda t: F.struct(t.role.alias("role"), t.content.alias("content")))
    nothing = {f.split(":")[0]: f.split(":")[1] for f in ("prompt:string", "response:string", "system:string", "instruction:string", "input:string", "output:string")}
    record = F.struct(messages.alias("messages"), F.lit(None).cast("array<struct<`from`:string,value:string>>").alias("conversations"), *[F.lit(None).cast(t).alias(n) for n, t in nothing.items()])
    return g.select("conv_id", record.alias("record"))


def format_digest(conversations: DataFrame) -> DataFrame:
    """Formats, reads back from the output, and digests it, per conversation."""
    f = format_records(turns_to_records(conversations))
    f = f.withColumn("_back", parse_formatted(F.col("formatted")))
    sha = lambda c: F.sha2(c.cast("binary"), 256)
    learned = F.array_join(F.transform("loss_spans", lambda s: unescaped(F.substring(F.col("formatted"), (s.start + 1).cast("int"), (s.end - s.start).cast("int")))), "")
    return f.withColumn("_learned", learned).select(
        "conv_id", F.size("_back").cast("bigint").alias("n_turns"), sha(F.array_join(F.transform("_back", lambda t: F.concat(t.role, F.lit("\n"), t.content, F.lit("\n"))), "")).alias("turns_sha256"),
        F.length("_learned").cast("bigint").alias("loss_chars"), sha(F.col("_learned")).alias("loss_sha256"), F.length("formatted").cast("bigint").alias("formatted_chars"))


def format_digest_sql(rows: str) -> str:
    """DuckDB; rows: a query of conv_id, turn, role, text."""
    esc = lambda c: rf"regexp_replace({c}, '([<\[])(\\*)({CONTROL})', '\1\2\\\3', 'g')"
    return f"""
    with r as (select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from ({rows}))
    select conv_id, count(*)::bigint n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn, role, text)) turns_sha256,
      coalesce(sum(length(text)) filter (where role = 'assistant'), 0)::bigint loss_chars, sha256(coalesce(string_agg(text, '' order by turn, role, text) filter (where role = 'assistant'), '')) loss_sha256,
      sum(length(replace(replace(replace({esc('role')}, '\\', '\\\\'), chr(10), '--'), chr(13), '--')) + length({esc('text')}) + {len(OPEN) + 1 + len(CLOSE)})::bigint formatted_chars
    from r group by conv_id"""

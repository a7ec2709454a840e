"""LIN description files as relations, and relations as sections of such a file.

A file is a row (path, text).  Sections are cut and entries are split by column
functions; the order of entries is kept in `seq`.  `read` and `write` take files
whole, the entries of each as arrays, and move nothing between files.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# The grammar of the sections.
SECTION = r"(?ms)^[ \t]*{name}\s*\{{(.*?)^\}}"
MASTER = r"Master\s*:\s*(\w+)\s*,\s*([\d.]+)\s*ms\s*,\s*([\d.]+)\s*ms"
SLAVES = r"Slaves\s*:\s*([^;]*);"
SIGNAL = r"(\w+)\s*:\s*(\d+)\s*,\s*(\{[^}]*\}|[^,;{]+?)\s*,\s*([^;]*);"
FRAME = r"(\w+)\s*:\s*(0[xX][0-9a-fA-F]+|\d+)\s*,\s*(\w+)\s*,\s*(\d+)\s*\{([^}]*)\}"
PLACED = r"(\w+)\s*,\s*(\d+)\s*;"
SCHEDULE = r"(\w+)\s*\{([^}]*)\}"
DELAY = r"(\w+)\s+delay\s+([\d.]+)\s*ms\s*;"


def _plain(text: Column) -> Column:
    """Text without comments."""
    # most files have no block comment, and a search for two bytes costs less than one by pattern
    blocks = F.when(F.contains(text, F.lit("/*")), F.regexp_replace(text, r"(?s)/\*.*?\*/", "")).otherwise(text)
    return F.regexp_replace(blocks, r"//[^\n]*", "")


def _all(text: str, pattern: str, names: list[str]) -> list[Column]:
    """One array for each group of a pattern."""
    return [F.regexp_extract_all(text, F.lit(pattern), F.lit(k + 1)).alias(n) for k, n in enumerate(names)]


def _items(text: Column) -> Column:
    """Items between commas, stripped."""
    # a split by a longer pattern would compile it for each text
    return F.split(F.regexp_replace(text, r"(?U)^\s+|(?<=,)\s+|\s+(?=,|\z)", ""), ",")


def read(files: DataFrame) -> DataFrame:
    """Files (path, text) with their entries in order, an array for each part.

    master, time_base, jitter (master is empty where there is none), slaves;
    signal, size, init_value, ends (publisher, then subscribers), signal_frame and
    offset (of the last frame that places the name, else '' and 0); frame, frame_id,
    frame_publisher, frame_size, body; table, and table_frame and delay_ms, which
    have an array for each table.
    """
    names = ["Nodes", "Signals", "Frames", "Schedule_tables"]
    cut = files.select("path", "text", _plain(F.col("text")).alias("_p"))
    cut = cut.select("path", "text", *[F.regexp_extract("_p", SECTION.format(name=n), 1).alias(f"_{n}") for n in names])
    found = cut.select(
        "path", "text", *[F.regexp_extract("_Nodes", MASTER, k + 1).alias(n) for k, n in enumerate(["master", "_base", "_jitter"])], F.regexp_extract("_Nodes", SLAVES, 1).alias("_slaves"),
        *_all("_Signals", SIGNAL, ["signal", "_size", "init_value", "_ends"]), *_all("_Frames", FRAME, ["frame", "_id", "frame_publisher", "_bytes", "body"]), *_all("_Schedule_tables", SCHEDULE, ["table", "_body"]),
    )
    number = lambda x: F.when(F.lower(x).startswith("0x"), F.conv(F.substring(x, 3, 16), 16, 10).cast("int")).otherwise(x.cast("int"))
    each = lambda column, pattern, k: F.transform(column, lambda x: F.regexp_extract_all(x, F.lit(pattern), F.lit(k)))
    own = found.select(
        "path", "text", "master", F.col("_base").try_cast("double").alias("time_base"), F.col("_jitter").try_cast("double").alias("jitter"), F.filter(_items(F.col("_slaves")), lambda x: x != "").alias("slaves"),
        "signal", F.col("_size").cast("array<int>").alias("size"), "init_value", F.transform("_ends", lambda x: F.filter(_items(x), lambda y, k: (k == 0) | (y != ""))).alias("ends"),
        "frame", F.transform("_id", number).alias("frame_id"), "frame_publisher", F.col("_bytes").cast("array<int>").alias("frame_size"), "body",
        "table", each("_body", DELAY, 1).alias("table_frame"), each("_body", DELAY, 2).cast("array<array<double>>").alias("delay_ms"),
        each("body", PLACED, 1).alias("_placed"), each("body", PLACED, 2).cast("array<array<int>>").alias("_at"),
    )
    # backwards, so that the first place found is the last
    holders = F.transform("frame", lambda x, k: F.array_repeat(x, F.size(F.get("_placed", k))))
    back = own.select(*own.drop("_placed", "_at").columns, *[F.reverse(F.flatten(c)).alias(n) for c, n in ((F.col("_placed"), "_names"), (F.col("_at"), "_places"), (holders, "_holders"))])
    back = back.withColumn("_k", F.transform("signal", lambda x: (F.array_position("_names", x) - 1).cast("int")))
    of = lambda column, otherwise: F.transform("_k", lambda k: F.coalesce(F.get(column, k), F.lit(otherwise)))
    return back.select(*own.drop("_placed", "_at").columns, of("_holders", "").alias("signal_frame"), of("_places", 0).alias("offset"))


def _rows(files: DataFrame, entries: Column) -> DataFrame:
    # explode would first ask for files with entries, and read each file twice for that
    return files.select("path", F.explode_outer(entries).alias("x")).where("x is not null").select("path", "x.*")


def nodes(files: DataFrame) -> DataFrame:
    """(path, seq, name, role, time_base, jitter)."""
    node = lambda seq, name, role, base, jitter: F.struct(seq.alias("seq"), name.alias("name"), F.lit(role).alias("role"), base.alias("time_base"), jitter.alias("jitter"))
    slaves = F.transform("slaves", lambda x, k: node(k + 1, x, "Slave", F.lit(0.0), F.lit(0.0)))
    master = F.array(node(F.lit(0), F.col("master"), "Master", F.col("time_base"), F.col("jitter")))
    return _rows(read(files), F.concat(F.when(F.col("master") != "", master).otherwise(F.slice(master, 1, 0)), slaves))


def frames(files: DataFrame) -> DataFrame:
    """(path, seq, name, frame_id, publisher, size, body)."""
    part = lambda c, k: F.get(c, k)
    return _rows(read(files), F.transform("frame", lambda x, k: F.struct(k.alias("seq"), x.alias("name"), part("frame_id", k).alias("frame_id"), part("frame_publisher", k).alias("publisher"), part("frame_size", k).alias("size"), part("body", k).alias("body"))))


def signals(files: DataFrame) -> DataFrame:
    """(path, seq, name, size, init_value, publisher, subscribers, frame, offset); the last frame that places a name wins."""
    part = lambda c, k: F.get(c, k)
    others = lambda x: F.slice(x, 2, F.size(x))
    return _rows(read(files), F.transform("signal", lambda x, k: F.struct(k.alias("seq"), x.alias("name"), part("size", k).alias("size"), part("init_value", k).alias("init_value"), F.get(part("ends", k), 0).alias("publisher"), others(part("ends", k)).alias("subscribers"), part("signal_frame", k).alias("frame"), part("offset", k).alias("offset"))))


def schedules(files: DataFrame) -> DataFrame:
    """(path, table, seq, frame, delay_ms)."""
    entries = lambda t, i: F.transform(F.get("table_frame", i), lambda x, k: F.struct(t.alias("table"), k.alias("seq"), x.alias("frame"), F.get(F.get("delay_ms", i), k).alias("delay_ms")))
    return _rows(read(files), F.flatten(F.transform("table", entries)))


def packed(size: Column) -> Column:
    """Offsets of signals one after the other from 0."""
    ends = F.aggregate(size, F.array(F.lit(0)), lambda acc, x: F.concat(acc, F.array(F.element_at(acc, -1) + x)))
    return F.slice(ends, 1, F.size(size))


def _number(x: Column) -> Column:
    return F.regexp_replace(F.coalesce(x.cast("string"), F.lit("null")), r"\.0$", "")


def _master_line(indent: str, name: Column, time_base: Column, jitter: Column) -> Column:
    return F.concat(F.lit(f"{indent}Master: "), name, F.lit(", "), _number(time_base), F.lit(" ms, "), _number(jitter), F.lit(" ms;\n"))


def _slaves_line(indent: str, names: Column) -> Column:
    return F.when(F.size(names) > 0, F.concat(F.lit(f"{indent}Slaves: "), F.array_join(names, ", "), F.lit(";\n"))).otherwise("")


def _signal_line(indent: str, name: Column, size: Column, init_value: Column, ends: Column) -> Column:
    return F.concat(F.lit(indent), name, F.lit(": "), size.cast("string"), F.lit(", "), init_value, F.lit(", "), F.array_join(ends, ", "), F.lit(";\n"))


def _frame_head(indent: str, name: Column, frame_id: Column, publisher: Column, size: Column) -> Column:
    return F.concat(F.lit(indent), name, F.lit(": "), F.format_string("0x%02X", frame_id), F.lit(", "), publisher, F.lit(", "), size.cast("string"), F.lit(" {\n"))


def _placed_line(indent: str, signal: Column, offset: Column) -> Column:
    return F.concat(F.lit(indent * 2), signal, F.lit(", "), offset.cast("string"), F.lit(";\n"))


def _delay_line(indent: str, frame: Column, delay_ms: Column) -> Column:
    return F.concat(F.lit(indent * 2), frame, F.lit(" delay "), _number(delay_ms), F.lit(" ms;\n"))


def write(files: DataFrame, indent: str = "  ") -> DataFrame:
    """(path, text): files with their entries, as read() gives them, in place of those in their texts; a section without entries stays as it is."""
    line = lambda x, k: _signal_line(indent, x, F.get("size", k), F.get("init_value", k), F.get("ends", k))
    places = F.sort_array(F.transform("signal", lambda x, k: F.struct(F.get("offset", k).alias("offset"), k.alias("seq"), x.alias("signal"), F.get("signal_frame", k).alias("frame"))))
    delays = lambda t, i: F.transform(F.get("table_frame", i), lambda x, k: F.struct(k.alias("seq"), _delay_line(indent, x, F.get(F.get("delay_ms", i), k)).alias("text"), t.alias("table")))
    lines = files.select("*", places.alias("_places"), F.sort_array(F.flatten(F.transform("table", delays))).alias("_delays"))
    placed = lambda f: F.transform(F.filter("_places", lambda x: x["frame"] == f), lambda x: _placed_line(indent, x["signal"], x["offset"]))
    frame = lambda f, k: F.concat(_frame_head(indent, f, F.get("frame_id", k), F.get("frame_publisher", k), F.get("frame_size", k)), F.array_join(placed(f), ""), F.lit(f"{indent}}}\n"))
    table = lambda t: F.concat(F.lit(indent), t, F.lit(" {\n"), F.array_join(F.transform(F.filter("_delays", lambda x: x["table"] == t), lambda x: x["text"]), ""), F.lit(f"{indent}}}\n"))
    texts = {
        "Nodes": ((F.col("master") != "") | (F.size("slaves") > 0), F.concat(F.when(F.col("master") != "", _master_line(indent, F.col("master"), F.col("time_base"), F.col("jitter"))).otherwise(""), _slaves_line(indent, F.col("slaves")))),
        "Signals": (F.size("signal") > 0, F.array_join(F.transform("signal", line), "")),
        "Frames": (F.size("frame") > 0, F.array_join(F.transform("frame", frame), "")),
        "Schedule_tables": (F.size("_delays") > 0, F.array_join(F.transform(F.sort_array(F.array_distinct(F.transform("_delays", lambda x: x["table"]))), table), "")),
    }
    out = lines.select("path", "text", *[F.when(some, F.concat(F.lit(f"{n} {{\n"), body, F.lit("}\n"))).alias(f"_{n}") for n, (some, body) in texts.items()])
    for name in texts:
        out = _replaced(out, name, f"_{name}")
    return out.select("path", "text")


def render_frames(frame_rows: DataFrame, signal_rows: DataFrame, indent: str = "  ") -> DataFrame:
    """(path, section): the Frames section, frames in order and signals by offset."""
    placed = signal_rows.where("frame <> ''").groupBy("path", F.col("frame").alias("name")).agg(F.sort_array(F.collect_list(F.struct("offset", "seq", F.col("name").alias("signal")))).alias("s"))
    lines = F.array_join(F.transform(F.coalesce("s", F.expr("cast(array() as array<struct<offset:int,seq:int,signal:string>>)")), lambda x: _placed_line(indent, x["signal"], x["offset"])), "")
    head = _frame_head(indent, *[F.col(c) for c in ("name", "frame_id", "publisher", "size")])
    one = frame_rows.join(placed, ["path", "name"], "left").select("path", "seq", F.concat(head, lines, F.lit(indent), F.lit("}\n")).alias("text"))
    body = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("seq", "text"))), lambda x: x["text"]), "")
    return one.groupBy("path").agg(F.concat(F.lit("Frames {\n"), body, F.lit("}\n")).alias("section"))


def render_signals(signal_rows: DataFrame, indent: str = "  ") -> DataFrame:
    """(path, section): the Signals section."""
    line = _signal_line(indent, F.col("name"), F.col("size"), F.col("init_value"), F.concat(F.array("publisher"), F.col("subscribers")))
    rows = signal_rows.select("path", "seq", line.alias("text"))
    body = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("seq", "text"))), lambda x: x["text"]), "")
    return rows.groupBy("path").agg(F.concat(F.lit("Signals {\n"), body, F.lit("}\n")).alias("section"))


def _joined(rows: DataFrame, name: str, line: Column) -> DataFrame:
    """(path, section): lines in order inside a section."""
    body = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("seq", line.alias("text")))), lambda x: x["text"]), "")
    return rows.groupBy("path").agg(F.concat(F.lit(f"{name} {{\n"), body, F.lit("}\n")).alias("section"))


def render_nodes(node_rows: DataFrame, indent: str = "  ") -> DataFrame:
    """(path, section): the Nodes section; the slaves in order on one line."""
    master = F.max(F.when(F.col("role") == "Master", _master_line(indent, F.col("name"), F.col("time_base"), F.col("jitter"))))
    slaves = F.transform(F.sort_array(F.collect_list(F.when(F.col("role") == "Slave", F.struct("seq", "name")))), lambda x: x["name"])
    return node_rows.groupBy("path").agg(F.concat(F.lit("Nodes {\n"), F.coalesce(master, F.lit("")), _slaves_line(indent, slaves), F.lit("}\n")).alias("section"))


def render_schedules(schedule_rows: DataFrame, indent: str = "  ") -> DataFrame:
    """(path, section): the Schedule_tables section, tables by name."""
    line = _delay_line(indent, F.col("frame"), F.col("delay_ms"))
    entries = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("seq", line.alias("text")))), lambda x: x["text"]), "")
    tables = schedule_rows.groupBy("path", "table").agg(F.concat(F.lit(indent), F.col("table"), F.lit(" {\n"), entries, F.lit(f"{indent}}}\n")).alias("text"))
    return _joined(tables.withColumn("seq", F.col("table")), "Schedule_tables", F.col("text"))


def _replaced(files: DataFrame, name: str, new: str) -> DataFrame:
    """Files with column `new` in place of the section of that name, or at the end where there is none; as they are where it is null."""
    found = SECTION.format(name=name)
    literal = F.replace(F.replace(F.col(new), F.lit("\\"), F.lit("\\\\")), F.lit("$"), F.lit("\\$"))
    by_pattern = F.regexp_replace("text", F.lit(rf"(?s)\A(.*?)(?:{found})\n?"), F.concat(F.lit("$1"), literal))
    # the first line that begins as the section does is where it was found; 0 where lines end otherwise than in \n
    whole = files.withColumn("_whole", F.regexp_extract("text", rf"(?:{found})\n?", 0))
    place = whole.withColumn("_place", F.instr(F.concat(F.lit("\n"), "text"), F.concat(F.lit("\n"), "_whole")))
    spliced = F.concat(F.substring("text", 1, F.col("_place") - 1), new, F.substring("text", F.col("_place") + F.length("_whole"), F.length("text")))
    text = F.when(F.col(new).isNull(), F.col("text")).when(F.col("_whole") == "", F.concat("text", F.lit("\n"), new)).when(F.col("_place") > 0, spliced).otherwise(by_pattern)
    return place.withColumn("text", text).drop("_whole", "_place", new)


def save(files: DataFrame, **sections: DataFrame) -> DataFrame:
    """(path, text): files with the given sections, Nodes=(path, section) and so on, in place of theirs; new ones go to the end, all else stays as it is."""
    out = files.select("path", "text")
    for name, rendered in sections.items():
        out = _replaced(out.join(rendered.select("path", "section"), "path", "left"), name, "section")
    return out


def append_schedule(schedule_rows: DataFrame, new: DataFrame) -> DataFrame:
    """Entries (path, table, frame, delay_ms, k) added at the end of their tables in the order of k; a table that is not there begins."""
    ends = schedule_rows.groupBy("path", "table").agg(F.max("seq").alias("_end"))
    place = F.row_number().over(Window.partitionBy("path", "table").orderBy("k")) + F.coalesce("_end", F.lit(-1))
    added = new.join(ends, ["path", "table"], "left").select("path", "table", place.cast("int").alias("seq"), "frame", "delay_ms")
    return schedule_rows.unionByName(added)


def delete_schedule(schedule_rows: DataFrame, gone: DataFrame) -> DataFrame:
    """Without the tables (path, table) of `gone`."""
    return schedule_rows.join(gone.select("path", "table").distinct(), ["path", "table"], "left_anti")

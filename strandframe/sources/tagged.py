"""Tagged-line files in text form: scan, tables, header, check and write.

The scan is Spark's own text source, numbered by `numbered`, so files are split and may lie in any
store. Fields are parsed by column expressions: a string is prefixed with its length in bytes, and
may hold spaces. A malformed number or a list shorter than it says stops the query.

    lines    file, line_no, line_type, obj_ord, group_ord, value  (ordinals from 0)
    objects  file, obj_ord, group_ord, a column a line type (a struct of several fields)
    groups   file, group_ord, the group's fields, first_obj, n_obj
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strandframe.sources import schema as S
from strandframe.sources.numbered import numbered

HEADER_ROWS = 20_000  # lines that are read for a header at first; more where they all belong to it


# --- fields --------------------------------------------------------------------------------


def _bytes(text: Column, start: Column | int, n: Column | None = None) -> Column:
    raw = text.cast("binary")
    start = F.lit(start) if isinstance(start, int) else start
    return F.substring(raw, start, n if n is not None else F.octet_length(text)).cast("string")


def _strings(text: Column, n: Column) -> Column:
    """n strings, each behind its length and a space; and what is left."""
    zero = F.struct(text.alias("rest"), F.array().cast("array<string>").alias("out"))

    def step(a, _):
        size = F.substring_index(a["rest"], " ", 1)
        at, k = F.octet_length(size) + 2, size.cast("int")
        return F.struct(_bytes(a["rest"], at + k + 1).alias("rest"), F.concat(a["out"], F.array(_bytes(a["rest"], at, k))).alias("out"))

    return F.when(n > 0, F.aggregate(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), zero, step)).otherwise(F.struct(text.alias("rest"), F.array().cast("array<string>").alias("out")))


def _scalar(token: Column, kind: str) -> Column:
    return token.cast(S.FIELDS[kind])


def parse(fields: tuple[str, ...], value: Column) -> tuple[list[Column], Column]:
    """The fields of a line after its letter, and its comment (null without one)."""
    at = next((i for i, f in enumerate(fields) if f in S.LISTS), None)
    lead = len(fields) if at is None else at
    parts = F.split(value, " ", lead + (2 if at is None else 3))
    out = [_scalar(parts[i + 1], fields[i]) for i in range(lead)]
    if at is None:
        comment = F.get(parts, F.lit(lead + 1))
        return out, F.when(comment != "", comment)
    kind, n = fields[at], parts[lead + 1].cast("int")
    rest = F.coalesce(F.get(parts, F.lit(lead + 2)), F.lit(""))
    tail = fields[at + 1 :]
    if kind in ("STRING", "DNA"):
        got = _bytes(rest, 1, n)
        short, after = F.octet_length(got) < n, _bytes(rest, n + 2)
        got = F.regexp_replace(F.lower(got), "[^acgt]", "a") if kind == "DNA" else got
    elif kind == "STRING_LIST":
        both = _strings(rest, n)
        got, after = both["out"], both["rest"]
        short, after = F.size(got) < n, F.ltrim(after)
    else:
        items = F.split(rest, " ")
        got = F.when(n > 0, F.slice(items, F.lit(1), F.greatest(n, F.lit(1)))).otherwise(F.array().cast("array<string>"))
        short = F.size(got) < n
        after = F.array_join(F.slice(items, n + 1, F.greatest(F.size(items) - n, F.lit(0))), " ") if tail else F.array_join(F.slice(items, n + 1, F.greatest(F.size(items), F.lit(1))), " ")
        got = F.transform(got, lambda x: x.cast(S.FIELDS[kind].elementType))
    # null stands for no value only where the error has been raised
    out.append(F.when(short, F.raise_error(F.concat(F.lit("a line is shorter than it says: "), F.substring(value, 1, 80)))).otherwise(got))
    more = F.split(after, " ", len(tail) + 1)
    out += [_scalar(F.get(more, F.lit(i)), f) for i, f in enumerate(tail)]
    comment = F.get(more, F.lit(len(tail)))
    return out, F.when(comment != "", comment)


def list_length(fields: tuple[str, ...], value: Column) -> Column:
    """The length that counts as a line's: of its list; for strings in a list, of all of them."""
    at = next((i for i, f in enumerate(fields) if f in S.LISTS), None)
    if at is None:
        return F.lit(None).cast("long")
    got = parse(fields, value)[0][at]
    if fields[at] == "STRING_LIST":
        return F.aggregate(got, F.lit(0).cast("long"), lambda a, s: a + F.octet_length(s))
    if fields[at] in ("STRING", "DNA"):
        return F.octet_length(got).cast("long")
    return F.size(got).cast("long")


def _real(x: Column, compat: bool) -> Column:
    return F.format_string("%f", x) if compat else x.cast("string")


def format_line(line: S.Line, values: list[Column], comment: Column | None = None, compat: bool = False) -> Column:
    """A line's text. Reals are written so that they read back the same, or with `compat` in six decimals."""
    parts: list[Column] = [F.lit(line.code)]
    for kind, v in zip(line.fields, values):
        if kind in ("STRING", "DNA"):
            parts += [F.octet_length(v).cast("string"), v]
        elif kind == "STRING_LIST":
            parts += [F.size(v).cast("string"), F.array_join(F.transform(v, lambda s: F.concat_ws(" ", F.octet_length(s).cast("string"), s)), " ")]
        elif kind == "REAL_LIST":
            parts += [F.size(v).cast("string"), F.array_join(F.transform(v, lambda x: _real(x, compat)), " ")]
        elif kind == "INT_LIST":
            parts += [F.size(v).cast("string"), F.array_join(v.cast("array<string>"), " ")]
        elif kind == "REAL":
            parts.append(_real(v, compat))
        else:
            parts.append(v.cast("string"))
    if line.list_at is not None and line.fields[line.list_at] not in ("STRING", "DNA"):
        # an empty list has no items and no space after its length
        i = 1 + line.list_at
        parts[i : i + 2] = [F.when(F.size(values[line.list_at]) > 0, F.concat_ws(" ", *parts[i : i + 2])).otherwise(parts[i])]
    return F.concat_ws(" ", *parts, *([comment] if comment is not None else []))


# --- header --------------------------------------------------------------------------------


@dataclass
class Header:
    type: S.FileType
    secondary: str | None = None
    provenance: list[tuple[str, ...]] = field(default_factory=list)  # program, version, command, date
    references: list[tuple[str, int]] = field(default_factory=list)
    deferred: list[str] = field(default_factory=list)
    counts: dict[tuple[str, str], int] = field(default_factory=dict)  # (sign, line type): #, @, +, g#, g+
    text: list[str] = field(default_factory=list)


def _token(raw: bytes, at: int) -> tuple[str, int]:
    end = raw.find(b" ", at)
    end = len(raw) if end < 0 else end
    return raw[at:end].decode(), end + 1


def _python_fields(fields: tuple[str, ...], row: str) -> tuple[list, str]:
    """The fields of one header line, on the driver."""
    raw, at, out = row.encode(), 2, []
    for kind in fields:
        word, at = _token(raw, at)
        if kind == "STRING":
            out.append(raw[at : at + int(word)].decode())
            at += int(word) + 1
        elif kind == "STRING_LIST":
            got = []
            for _ in range(int(word)):
                n, at = _token(raw, at)
                got.append(raw[at : at + int(n)].decode())
                at += int(n) + 1
            out.append(got)
        else:
            out.append(int(word) if kind == "INT" else word)
    return out, raw[at:].decode()


def parse_header(rows: list[str], types: dict[str, S.FileType] | None = None, kind: str | None = None) -> Header:
    """A header from a file's first lines, up to its first data line.

    `kind` is needed only where the file does not begin with its type; where both say one they
    must agree. Types that the file defines itself are checked against given ones.
    """
    name, own, secondary, rest = kind, None, None, []
    for i, row in enumerate(rows):
        if row[:1].isalpha():
            break
        if row.startswith("1 "):
            if i:
                raise S.SchemaError("the line of the type is not the first")
            (stated, major, minor), _ = _python_fields(S.HEADER_LINES["1"], row)
            if major != S.MAJOR or minor > S.MINOR:
                raise S.SchemaError(f"version {major}.{minor} is not supported")
            own = S.FileType(stated)
            if kind and kind != stated and not (types and kind in S.find(types, stated).secondaries):
                raise S.SchemaError(f"the file is of type {stated}, not {kind}")
            name = stated
        elif row and row[0] in S.HEADER_LINES:
            rest.append(row)
        elif row:
            raise S.SchemaError(f"not a header line: {row[:80]!r}")
    if name is None:
        raise S.SchemaError("the file does not say its type, and none is given")
    own = own or S.FileType(name)
    out = Header(own)
    for row in rest:
        code = row[0]
        got, comment = _python_fields(S.HEADER_LINES[code], row)
        if code == "2":
            secondary = got[0]
        elif code == "~":
            own.add(S.Line(got[1], got[0], tuple(got[2]), comment))
        elif code == "!":
            out.provenance.append(tuple(got[0]))
        elif code == "<":
            out.references.append((got[0], got[1]))
        elif code == ">":
            out.deferred.append(got[0])
        elif code in "#@+":
            out.counts[code, got[0]] = got[1]
        elif code == "%":
            out.counts["g" + got[1], got[2]] = got[3]
        elif code == "." and len(row) > 2:
            out.text.append(row[2:])
    given = None
    if types is not None:
        given = S.find(types, name)
        if secondary and secondary not in given.secondaries:
            raise S.SchemaError(f"{secondary} is not a kind of {given.primary}")
    out.type, out.secondary = S.merged(given, own), secondary
    return out


def header(spark: SparkSession, path: str, types: dict[str, S.FileType] | None = None, kind: str | None = None) -> Header:
    """The header of the (first) file. Without `types` the file must define its lines."""
    most = HEADER_ROWS
    while True:
        rows = [r[0] for r in spark.read.text(path).limit(most).collect()]
        # a header ends with the first line of a letter; there is no more to read where the file is shorter
        if len(rows) < most or rows[-1][:1].isalpha():
            return parse_header(rows, types, kind)
        most *= 8


# --- tables --------------------------------------------------------------------------------


def lines(spark: SparkSession, path: str | list[str], kind: S.FileType, whole: bool = False, codes: str | None = None) -> DataFrame:
    """The line table, of the line types in `codes` or all; what a type does not define stops the query.

    A line that qualifies the object after it (a pair mark) gets that object's ordinal. Letters
    that hold until they come again are in `last_<letter>` of every line.
    """
    sticky = "".join(c for c in S.STICKY.get(kind.primary, ()) if c in kind.lines)
    rows = numbered(spark, path, {"n_obj": kind.object} | ({"n_group": kind.group} if kind.group else {}), sticky, whole)
    t = F.substring("value", 1, 1)
    rows = rows.filter(t.rlike("[A-Za-z]") & (t.isin(*codes) if codes else F.lit(True)))
    ahead = S.FORWARD.get(kind.primary, frozenset())
    known = F.when(t.isin(*kind.lines), t).otherwise(F.raise_error(F.concat(F.lit("an unknown line type: "), F.substring("value", 1, 80))))
    return rows.select(
        "file",
        "line_no",
        known.alias("line_type"),
        (F.col("n_obj") - F.when(t.isin(*ahead), 0).otherwise(1) if ahead else F.col("n_obj") - 1).alias("obj_ord"),
        (F.when(F.col("n_group") > 0, F.col("n_group") - 1) if kind.group else F.lit(None).cast("long")).alias("group_ord"),
        "value",
        *[f"last_{c}" for c in sticky],
    )


def _packed(line: S.Line, value: Column) -> Column:
    """One field as it is, several as a struct, none as true."""
    got, _ = parse(line.fields, value)
    if not got:
        return F.lit(True)
    return got[0] if len(got) == 1 else F.struct(*[c.alias(f"{line.code}{i}") for i, c in enumerate(got)])


def objects(table: DataFrame, kind: S.FileType, codes: str | None = None) -> DataFrame:
    """One row an object; of a line type that comes again after one object, the last line counts.

    Columns carry code, role and comment in their metadata. Sticky letters are those in force
    at the object.
    """
    use = [x for c, x in kind.lines.items() if x.role != "G" and (codes is None or c in codes or x.role == "O")]
    sticky = S.STICKY.get(kind.primary, frozenset())
    t, out = F.col("line_type"), []
    for x in use:
        own = F.when(t == x.code, F.col("line_no"))
        if x.code in sticky and f"last_{x.code}" in table.columns:
            v = F.when(F.col(f"last_{x.code}").isNotNull(), _packed(x, F.col(f"last_{x.code}")))
            own = F.when(t == kind.object, F.col("line_no"))
        else:
            v = F.when(t == x.code, _packed(x, F.col("value")))
        out.append(F.max_by(v, own).alias(x.code, metadata={"code": x.code, "role": x.role, "comment": x.comment}))
    group = F.max(F.when(t == kind.object, F.col("group_ord"))).alias("group_ord")
    return table.filter("obj_ord >= 0").groupBy("file", "obj_ord").agg(group, *out)


def groups(table: DataFrame, kind: S.FileType) -> DataFrame:
    """file, group_ord, the group's fields, first_obj and n_obj, as found."""
    x = kind.lines[kind.group]
    own = table.filter(F.col("line_type") == x.code)
    got, _ = parse(x.fields, F.col("value"))
    heads = own.select("file", "group_ord", *[c.alias(f"{x.code}{i}") for i, c in enumerate(got)], (F.col("obj_ord") + 1).alias("first_obj"))
    n = table.filter(F.col("line_type") == kind.object).groupBy("file", "group_ord").agg(F.count("*").alias("n_obj"))
    return heads.join(n, ["file", "group_ord"], "left").withColumn("n_obj", F.coalesce("n_obj", F.lit(0)))


def counts(table: DataFrame, kind: S.FileType) -> DataFrame:
    """file, line_type, n, max_len, total_len, group_max_n, group_max_len; lines before the first group in no group."""
    t = F.col("line_type")
    size = F.coalesce(*[F.when(t == c, list_length(x.fields, F.col("value"))) for c, x in kind.lines.items() if x.list_at is not None], F.lit(None).cast("long"))
    per = table.withColumn("len", size).groupBy("file", "line_type", "group_ord").agg(F.count("*").alias("n"), F.max("len").alias("longest"), F.sum("len").alias("total"))
    inside = lambda c: F.max(F.when(F.col("group_ord").isNotNull() & (t != (kind.group or "")), F.col(c)))
    return per.groupBy("file", "line_type").agg(F.sum("n").alias("n"), F.max("longest").alias("max_len"), F.sum("total").alias("total_len"), inside("n").alias("group_max_n"), inside("total").alias("group_max_len"))


def group_mismatches(table: DataFrame, kind: S.FileType) -> DataFrame:
    """Groups whose stated number of objects is not the one found."""
    g = groups(table, kind)
    return g.filter(F.col(f"{kind.group}0") != F.col("n_obj")).select("file", "group_ord", F.col(f"{kind.group}0").alias("given"), F.col("n_obj").alias("found"))


def count_mismatches(found: DataFrame, head: Header) -> DataFrame:
    """line_type, sign, given, found, state of a counts() table against the header: bad or missing."""
    cells = {"#": "n", "@": "max_len", "+": "total_len", "g#": "group_max_n", "g+": "group_max_len"}
    spark = found.sparkSession
    given = spark.createDataFrame([(t, s, n) for (s, t), n in head.counts.items()], "line_type string, sign string, given long")
    flat = found.select("line_type", F.explode(F.array(*[F.struct(F.lit(s).alias("sign"), F.col(c).cast("long").alias("found")) for s, c in cells.items()])).alias("c")).select("line_type", "c.*")
    both = given.join(flat.filter("found is not null"), ["line_type", "sign"], "full_outer").fillna(0, ["given", "found"])
    state = F.when((F.col("given") > 0) & (F.col("given") != F.col("found")), "bad").when((F.col("given") == 0) & (F.col("found") > 0), "missing")
    return both.withColumn("state", state).filter("state is not null")


# --- write ---------------------------------------------------------------------------------


def header_lines(head: Header, found: list | None = None) -> list[str]:
    """The header's text: type, provenance, references, the types of lines, and counts (rows of counts())."""
    n = lambda s: f"{len(s.encode())} {s}"
    out = [f"1 3 {head.type.primary} {S.MAJOR} {S.MINOR}"]
    if head.secondary:
        out.append(f"2 3 {head.secondary}")
    out += [f"! {len(p)} " + " ".join(n(x) for x in p) for p in head.provenance]
    out += [f"< {n(f)} {k}" for f, k in head.references] + [f"> {n(f)}" for f in head.deferred]
    for x in sorted(head.type.lines.values(), key=lambda x: "GOD".index(x.role)):
        out.append("~ " + x.definition())
    out += [f". {t}" for t in head.text]
    for r in sorted(found or [], key=lambda r: (r["line_type"].islower(), r["line_type"])):
        t, g = r["line_type"], head.type.group
        out.append(f"# {t} {r['n']}")
        if r["max_len"]:
            out += [f"@ {t} {r['max_len']}", f"+ {t} {r['total_len']}"]
        if g and t != g and r["group_max_n"]:
            out.append(f"% {g} # {t} {r['group_max_n']}")
            if r["group_max_len"]:
                out.append(f"% {g} + {t} {r['group_max_len']}")
    return out


def object_lines(table: DataFrame, kind: S.FileType, group_table: DataFrame | None = None, compat: bool = False) -> DataFrame:
    """obj_ord, k, value: the lines of an object table (and a groups() table), in the order of (obj_ord, k)."""
    ahead = S.FORWARD.get(kind.primary, frozenset())
    use = [x for x in kind.lines.values() if x.role != "G" and x.code in table.columns]
    order = sorted(use, key=lambda x: (0 if x.code in ahead else 1 if x.role == "O" else 2, x.code))
    cells = []
    for k, x in enumerate(order, 1):
        c = F.col(x.code)
        values = [] if not x.fields else [c] if len(x.fields) == 1 else [c[f"{x.code}{i}"] for i in range(len(x.fields))]
        has = c.isNotNull() if x.fields else F.coalesce(c, F.lit(False))
        cells.append(F.when(has, F.struct(F.lit(k).alias("k"), format_line(x, values, None, compat).alias("value"))))
    out = table.select("obj_ord", F.explode(F.array_compact(F.array(*cells))).alias("l")).select("obj_ord", "l.k", "l.value")
    if group_table is not None and kind.group:
        x = kind.lines[kind.group]
        # a stated size is always computed
        values = [F.col("n_obj") if i == 0 and f == "INT" else F.col(f"{x.code}{i}") for i, f in enumerate(x.fields)]
        out = out.unionByName(group_table.select(F.col("first_obj").alias("obj_ord"), (F.col("group_ord") * 0).cast("int").alias("k"), format_line(x, values, None, compat).alias("value")))
    return out


def write_text(rows: DataFrame, head: list[str], path: str, mode: str = "error") -> None:
    """Write obj_ord, k, value as the parts of one file, in order, the header first. Read it with `whole`."""
    top = rows.sparkSession.createDataFrame([(-1, i, v) for i, v in enumerate(head)], "obj_ord long, k int, value string")
    every = top.unionByName(rows.select(F.col("obj_ord").cast("long").alias("obj_ord"), F.col("k").cast("int").alias("k"), "value"))
    every.repartitionByRange("obj_ord", "k").sortWithinPartitions("obj_ord", "k").select("value").write.mode(mode).text(path)


def inherit(*heads: Header, step: tuple[str, str, str, str]) -> Header:
    """A header for what is made from files: their provenance, references and deferred files, and the new step."""
    first = heads[0]
    seen = lambda name: list(dict.fromkeys(x for h in heads for x in getattr(h, name)))
    return Header(first.type, first.secondary, [*seen("provenance"), step], seen("references"), seen("deferred"), {}, list(first.text))


def without_header(rows: DataFrame, column: str = "value") -> DataFrame:
    return rows.filter(F.col(column).rlike("^[A-Za-z]"))


def resolve(name: str, suffixes: list[str], exists) -> str:
    """The first of name and name plus a suffix that exists."""
    for s in ["", *suffixes]:
        if exists(name + s):
            return name + s
    raise FileNotFoundError(f"{name} with none of {suffixes}")


def expand_blocks(pattern: str, exists) -> list[str]:
    """'x.@' is x.1, x.2 and so on while they exist; '@i' begins at i, '@i-j' ends at j."""
    m = re.fullmatch(r"(.*)@(?:(\d+)(?:-(\d+))?)?(.*)", pattern)
    if not m:
        return [pattern]
    at, last, out = int(m[2] or 1), int(m[3]) if m[3] else None, []
    while (last is None or at <= last) and exists(f"{m[1]}{at}{m[4]}"):
        out.append(f"{m[1]}{at}{m[4]}")
        at += 1
    if last is not None and at <= last or not out:
        raise FileNotFoundError(f"{m[1]}{at}{m[4]}")
    return out

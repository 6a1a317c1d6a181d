"""Schemas of tagged-line files: parsing, checks, and the Spark types of their lines.

A schema text lists file types. `P` begins a primary type, `S` names a secondary one; `G`, `O` and
`D` define the group line (at most one), the object line (exactly one) and other lines of a type:
a one-letter code, the number of fields, and each field's type behind the length of its name. What
follows is a comment. Lines that begin with `.` are comments, `1` and `!` header lines.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import types as T

#: Names of field types, and their Spark types.
FIELDS = {
    "INT": T.LongType(),
    "REAL": T.DoubleType(),
    "CHAR": T.StringType(),
    "STRING": T.StringType(),
    "INT_LIST": T.ArrayType(T.LongType(), False),
    "REAL_LIST": T.ArrayType(T.DoubleType(), False),
    "STRING_LIST": T.ArrayType(T.StringType(), False),
    "DNA": T.StringType(),
}
LISTS = frozenset(("STRING", "INT_LIST", "REAL_LIST", "STRING_LIST", "DNA"))
MAJOR, MINOR = 1, 1
MOST_FIELDS = 32

#: Header and footer lines that every file may have, and their fields.
HEADER_LINES = {
    "1": ("STRING", "INT", "INT"),
    "2": ("STRING",),
    "#": ("CHAR", "INT"),
    "@": ("CHAR", "INT"),
    "+": ("CHAR", "INT"),
    "%": ("CHAR", "CHAR", "CHAR", "INT"),
    "!": ("STRING_LIST",),
    "<": ("STRING", "INT"),
    ">": ("STRING",),
    "~": ("CHAR", "CHAR", "STRING_LIST"),
    ".": (),
    "$": ("INT",),
    "^": (),
    "-": ("INT",),
    "&": ("INT_LIST",),
    "*": ("INT_LIST",),
    ";": ("CHAR", "STRING"),
    "/": ("STRING",),
}

#: The file types of genome assembly, one line a definition.
GENOMICS = """\
P 3 seq
S 3 irp
S 3 pbr
S 3 10x
S 3 ctg
S 3 kmr
G g 2 3 INT 6 STRING
O S 1 3 DNA
D I 1 6 STRING
D Q 1 6 STRING
D P 0
D W 4 3 INT 3 INT 3 INT 4 REAL
D N 4 4 REAL 4 REAL 4 REAL 4 REAL
D A 1 6 STRING
D C 1 3 INT
P 3 rmp
S 3 rmm
S 3 rms
S 3 rma
G r 3 3 INT 3 INT 11 STRING_LIST
O R 2 3 INT 8 INT_LIST
D E 1 8 INT_LIST
D I 1 9 REAL_LIST
D N 1 9 REAL_LIST
D O 1 3 INT
P 3 aln
S 3 sxs
S 3 rxr
S 3 sxr
S 3 map
G g 2 3 INT 6 STRING
O A 2 3 INT 3 INT
D I 6 3 INT 3 INT 3 INT 3 INT 3 INT 3 INT
D Q 1 3 INT
D M 1 3 INT
D D 1 3 INT
D C 1 6 STRING
D U 1 8 INT_LIST
D V 1 8 INT_LIST
D T 1 3 INT
D W 1 8 INT_LIST
D X 1 8 INT_LIST
P 3 hit
S 3 s2k
S 3 k2s
O H 2 3 INT 8 INT_LIST
D O 1 8 INT_LIST
D P 1 8 INT_LIST
P 3 jns
O J 6 3 INT 3 INT 4 CHAR 3 INT 3 INT 4 CHAR
D G 2 3 INT 3 INT
D Q 1 3 INT
D E 1 8 INT_LIST
P 3 brk
O B 3 3 INT 3 INT 3 INT
D Q 1 3 INT
D E 1 8 INT_LIST
P 3 lis
S 3 lyo
S 3 scf
O L 1 8 INT_LIST
D N 1 6 STRING
D S 1 3 INT
"""

#: Lines that qualify the object after them, and lines that hold until they come again.
FORWARD = {"seq": frozenset("P")}
STICKY = {"aln": frozenset("T")}


class SchemaError(ValueError):
    pass


@dataclass(frozen=True)
class Line:
    """A line type: its code, its role (G, O or D), and the types of its fields."""

    code: str
    role: str
    fields: tuple[str, ...]
    comment: str = ""

    @property
    def list_at(self) -> int | None:
        """The place of its one field with a length."""
        return next((i for i, f in enumerate(self.fields) if f in LISTS), None)

    def definition(self) -> str:
        parts = [self.role, self.code, str(len(self.fields)), *[f"{len(f)} {f}" for f in self.fields]]
        return " ".join(parts) + (f" {self.comment}" if self.comment else "")


@dataclass
class FileType:
    primary: str
    secondaries: list[str] = field(default_factory=list)
    lines: dict[str, Line] = field(default_factory=dict)

    def _only(self, role: str) -> str | None:
        return next((c for c, x in self.lines.items() if x.role == role), None)

    @property
    def object(self) -> str | None:
        return self._only("O")

    @property
    def group(self) -> str | None:
        return self._only("G")

    def add(self, line: Line) -> None:
        if line.code in self.lines:
            raise SchemaError(f"{self.primary}: line {line.code} is defined twice")
        if not (len(line.code) == 1 and line.code.isascii() and line.code.isalpha()):
            raise SchemaError(f"{self.primary}: {line.code!r} is not a letter")
        if line.role in "GO" and self._only(line.role):
            raise SchemaError(f"{self.primary}: a second {'group' if line.role == 'G' else 'object'} line, {line.code}")
        if len(line.fields) > MOST_FIELDS:
            raise SchemaError(f"{self.primary}: line {line.code} has {len(line.fields)} fields")
        if unknown := [f for f in line.fields if f not in FIELDS]:
            raise SchemaError(f"{self.primary}: line {line.code} has unknown fields {unknown}")
        if sum(f in LISTS for f in line.fields) > 1:
            raise SchemaError(f"{self.primary}: line {line.code} has several lists")
        self.lines[line.code] = line

    def struct(self, code: str) -> T.StructType:
        """The fields of a line as a struct; code, role and comment are metadata of each."""
        line = self.lines[code]
        note = {"code": code, "role": line.role, "comment": line.comment}
        return T.StructType([T.StructField(f"{code}{i}", FIELDS[f], True, note) for i, f in enumerate(line.fields)])

    def text(self) -> str:
        rows = [f"P 3 {self.primary}", *[f"S 3 {s}" for s in self.secondaries], *[x.definition() for x in self.lines.values()]]
        return "\n".join(rows) + "\n"


def definition(text: str) -> Line:
    """A definition 'role code n length type ...' with an optional comment."""
    parts = text.split(" ")
    try:
        role, code, n = parts[0], parts[1], int(parts[2])
    except (IndexError, ValueError):
        raise SchemaError(f"not a definition: {text!r}") from None
    fields, at = [], 3
    for _ in range(n):
        if at + 1 >= len(parts) or not parts[at].isdigit() or len(parts[at + 1]) != int(parts[at]):
            raise SchemaError(f"a field's length and name differ: {text!r}")
        fields.append(parts[at + 1])
        at += 2
    return Line(code, role, tuple(fields), " ".join(parts[at:]).strip())


def _name(text: str) -> str:
    parts = text.split(" ")
    if len(parts) < 3 or parts[1] != "3" or len(parts[2]) != 3:
        raise SchemaError(f"a type's name has three letters: {text!r}")
    return parts[2]


def parse_schema(text: str) -> dict[str, FileType]:
    """File types by their primary name."""
    out: dict[str, FileType] = {}
    now: FileType | None = None

    def done():
        if now is not None and now.object is None:
            raise SchemaError(f"{now.primary} has no object line")

    for row in text.splitlines():
        row = row.rstrip("\r")
        if not row or row[0] in ".1!":
            continue
        if row[0] == "P":
            done()
            now = FileType(_name(row))
            if now.primary in out:
                raise SchemaError(f"{now.primary} is defined twice")
            out[now.primary] = now
        elif now is None:
            raise SchemaError(f"a line before the first type: {row!r}")
        elif row[0] == "S":
            now.secondaries.append(_name(row))
        elif row[0] in "GOD":
            now.add(definition(row))
        else:
            raise SchemaError(f"not a schema line: {row!r}")
    done()
    return out


def genomics() -> dict[str, FileType]:
    return parse_schema(GENOMICS)


def find(types: dict[str, FileType], name: str) -> FileType:
    """The file type of a primary or secondary name."""
    for t in types.values():
        if name == t.primary or name in t.secondaries:
            return t
    raise SchemaError(f"no file type {name!r}")


def mismatches(have: FileType, need: FileType) -> list[str]:
    """What `have` lacks of a requirement: each of its lines, with the same fields. Further lines are no fault."""
    out = []
    for code, line in need.lines.items():
        if code not in have.lines:
            out.append(f"line {code} is missing")
        elif have.lines[code].fields != line.fields:
            out.append(f"line {code} has fields {have.lines[code].fields}, not {line.fields}")
    return out


def merged(given: FileType | None, embedded: FileType | None) -> FileType:
    """The type to read with: a given one, which lines that the file defines itself must match, or the file's own."""
    if given is None and (embedded is None or embedded.object is None):
        raise SchemaError("no schema is given, and the file has none")
    if given is None:
        return embedded
    for code, line in (embedded.lines if embedded else {}).items():
        if code in given.lines and given.lines[code].fields != line.fields:
            raise SchemaError(f"line {code} is {line.fields} in the file and {given.lines[code].fields} in the schema")
    return given

"""The SQL dialect: tokens, rewriting to Spark SQL, and batches.

``translate`` turns one SELECT into Spark SQL text; Catalyst does the rest.  Differences that are rewritten: ``[x]`` names, ``#date#`` and ``0x``
literals, TRUE/FALSE, ``&``, ``\\``, ``^``, MOD, BAND/BOR/BXOR/BNOT, IIF, the function library, TOP, trailing SKIP, the one-row table, parameters ``@p`` and ``?``, ``--`` lines.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from typing import Any

from pyspark.sql import DataFrame, SparkSession

from quillon.operators.paging import rows_after

_TOKEN = re.compile(
    r"""(?P<space>\s+)|(?P<text>'(?:[^']|'')*'|"(?:[^"]|"")*")|(?P<name>`[^`]*`|\[[^\]]*\])|(?P<date>\#[^#\n]*\#)|(?P<guid>\{[0-9a-fA-F-]{36}\})|(?P<bytes>0[xX][0-9a-fA-F]*)"""
    r"""|(?P<number>\d+(?:\.\d*)?(?:[eE][+-]?\d+)?|\.\d+(?:[eE][+-]?\d+)?)|(?P<global>@@\w+)|(?P<param>@\w+|\?)|(?P<dual>\#\w+)|(?P<word>\w+)|(?P<op><>|<=|>=|!=|.)""",
    re.S,
)

#: Functions of the dialect that only have another name in Spark.
RENAMED = {
    "LCASE": "lower", "UCASE": "upper", "LEN": "length", "SQR": "sqrt", "ATN": "atan", "SGN": "signum", "LOG": "ln", "STDEV": "stddev_samp", "STDEVP": "stddev_pop",
    "VAR": "var_samp", "VARP": "var_pop", "RND": "rand", "NOW": "current_timestamp", "LENB": "octet_length", "ROUND": "bround", "DATEVALUE": "to_date", "NZ": "coalesce",
}
_PARTS = {"yyyy": "YEAR", "q": "QUARTER", "m": "MONTH", "d": "DAY", "y": "DAYOFYEAR", "h": "HOUR", "n": "MINUTE", "s": "SECOND", "w": "DAYOFWEEK"}
_CASTS = {"CINT": "smallint", "CLNG": "int"}


class DialectError(ValueError):
    pass


@dataclass
class Token:
    kind: str
    text: str


def tokenize(sql: str) -> list[Token]:
    """Tokens without white space; lines that begin with ``--`` are dropped."""
    sql = "\n".join(x for x in sql.splitlines() if not x.lstrip().startswith("--"))
    return [Token(m.lastgroup, m[0]) for m in _TOKEN.finditer(sql) if m.lastgroup != "space"]


def split_batch(sql: str) -> list[str]:
    """Statements between semicolons outside quotes."""
    out, current = [], []
    sql = "\n".join(x for x in sql.splitlines() if not x.lstrip().startswith("--"))
    for m in _TOKEN.finditer(sql):
        if m.lastgroup == "op" and m[0] == ";":
            out.append("".join(current).strip())
            current = []
        else:
            current.append(m[0])
    out.append("".join(current).strip())
    return [s for s in out if s]


def split_condition(statement: str) -> tuple[bool, str, str] | None:
    """(wanted, query, statement) of ``IF [NOT] EXISTS (query) THEN statement``."""
    m = re.match(r"\s*IF\s+(NOT\s+)?EXISTS\s*\(", statement, re.I)
    if not m:
        return None
    depth, at = 1, m.end()
    for t in _TOKEN.finditer(statement, m.end()):
        depth += {"(": 1, ")": -1}.get(t[0], 0) if t.lastgroup == "op" else 0
        at = t.end()
        if not depth:
            break
    then = re.match(r"\s*THEN\s+", statement[at:], re.I)
    if depth or not then:
        raise DialectError("IF EXISTS needs (query) THEN statement")
    return not m[1], statement[m.end() : at - 1], statement[at + then.end() :]


class _Writer:
    """Writes expressions by precedence; statements pass through clause by clause."""

    def __init__(self, tokens: list[Token], args: dict | list | None) -> None:
        self.tokens, self.at, self.args, self.used = tokens, 0, args, 0
        #: Of the SELECT written last: its SKIP, if it has no TOP.
        self.offset: int | None = None

    def peek(self, ahead: int = 0) -> Token:
        i = self.at + ahead
        return self.tokens[i] if i < len(self.tokens) else Token("end", "")

    def next(self) -> Token:
        t = self.peek()
        self.at += 1
        return t

    def is_word(self, *words: str, ahead: int = 0) -> bool:
        t = self.peek(ahead)
        return t.kind == "word" and t.text.upper() in words

    def expect(self, text: str) -> None:
        if self.next().text.upper() != text:
            raise DialectError(f"expected {text} near {' '.join(t.text for t in self.tokens[max(0, self.at - 4) : self.at + 3])!r}")

    # select

    def query(self) -> str:
        out = self.select()
        while self.is_word("UNION", "INTERSECT", "EXCEPT"):
            op = self.next().text.upper()
            if self.is_word("ALL"):
                self.next()
                op += " ALL"
            out += f" {op} " + (self.parenthesised() if self.peek().text == "(" else self.select())
        if self.is_word("ORDER"):
            out += " " + self.order()
        return out

    def parenthesised(self) -> str:
        self.expect("(")
        out = self.query()
        self.expect(")")
        return f"({out})"

    def select(self) -> str:
        if self.peek().text == "(":
            return self.parenthesised()
        self.expect("SELECT")
        head, top = "SELECT", None
        while self.is_word("DISTINCT", "ALL", "DISTINCTROW", "TOP"):
            word = self.next().text.upper()
            if word == "TOP":
                top = self.constant_sum()
            elif word != "ALL":
                head += " DISTINCT"
        items = [self.item()]
        while self.peek().text == ",":
            self.next()
            items.append(self.item())
        out = f"{head} {', '.join(items)}"
        if self.is_word("FROM"):
            self.next()
            source = self.sources()
            out += f" FROM {source}" if source else ""
        if self.is_word("WHERE"):
            self.next()
            out += f" WHERE {self.expression()}"
        if self.is_word("GROUP"):
            self.next()
            self.expect("BY")
            keys = [self.expression()]
            while self.peek().text == ",":
                self.next()
                keys.append(self.expression())
            out += f" GROUP BY {', '.join(keys)}"
        if self.is_word("HAVING"):
            self.next()
            out += f" HAVING {self.expression()}"
        if self.is_word("ORDER"):
            out += " " + self.order()
        skip = None
        if self.is_word("SKIP"):
            self.next()
            skip = self.constant_sum()
        self.offset = skip if skip and top is None else None
        if top is not None:
            out += f" LIMIT {top}"
        return out + (f" OFFSET {skip}" if skip else "")

    def constant_sum(self) -> int:
        """TOP 5, TOP @p, TOP @a + @b, TOP 3+4: a number known before the query runs."""
        total = self.constant()
        while self.peek().text == "+":
            self.next()
            total += self.constant()
        return total

    def constant(self) -> int:
        t = self.next()
        value = self.argument(t) if t.kind == "param" else t.text
        try:
            n = int(value)
        except (TypeError, ValueError):
            raise DialectError("TOP and SKIP take whole numbers") from None
        if n < 0:
            raise DialectError("TOP and SKIP take no negative numbers")
        return n

    def argument(self, t: Token) -> Any:
        if isinstance(self.args, dict):
            key = t.text[1:]
            if key in self.args:
                return self.args[key]
        elif self.args is not None and t.text == "?":
            self.used += 1
            if self.used <= len(self.args):
                return self.args[self.used - 1]
        raise DialectError(f"no value for the parameter {t.text}")

    def item(self) -> str:
        if self.peek().text == "*":
            self.next()
            return "*"
        out = self.expression()
        if self.is_word("AS"):
            self.next()
            out += f" AS {self.identifier()}"
        return out

    def identifier(self) -> str:
        t = self.next()
        if t.kind == "name":
            return f"`{t.text[1:-1]}`"
        if t.kind != "word":
            raise DialectError(f"expected a name, found {t.text!r}")
        return f"`{t.text}`"

    def sources(self) -> str:
        parts = [self.joined()]
        while self.peek().text == ",":
            self.next()
            parts.append(self.joined())
        return " CROSS JOIN ".join(p for p in parts if p)

    def joined(self) -> str:
        out = self.source()
        while self.is_word("INNER", "LEFT", "RIGHT", "JOIN", "FULL", "CROSS"):
            kind = ""
            while not self.is_word("JOIN"):
                kind += self.next().text.upper() + " "
            self.next()
            out += f" {kind}JOIN {self.source()}"
            if self.is_word("ON"):
                self.next()
                out += f" ON {self.expression()}"
        return out

    def source(self) -> str:
        t = self.peek()
        if t.kind == "dual":
            self.next()
            return self.alias("(SELECT 1 AS `one`)")
        if t.text == "(":
            if self.is_word("SELECT", ahead=1) or self._nested_select():
                return self.alias(self.parenthesised())
            self.next()
            inner = self.sources()
            self.expect(")")
            return self.alias(f"({inner})")
        out = self.identifier()
        while self.peek().text == ".":
            self.next()
            out += "." + self.identifier()
        return self.alias(out)

    def _nested_select(self) -> bool:
        i = 0
        while self.peek(i).text == "(":
            i += 1
        if not self.is_word("SELECT", ahead=i):
            return False
        depth, j = i, i
        while depth > 0 and self.peek(j).kind != "end":
            depth += {"(": 1, ")": -1}.get(self.peek(j).text, 0) if j > i else 0
            j += 1
            if depth == 1 and j > i and self.peek(j).kind == "word" and self.peek(j).text.upper() in ("UNION", "INTERSECT", "EXCEPT"):
                return True
        return False

    def alias(self, out: str) -> str:
        if self.is_word("AS"):
            self.next()
            return f"{out} AS {self.identifier()}"
        t = self.peek()
        if t.kind == "name" or t.kind == "word" and t.text.upper() not in _CLAUSES:
            return f"{out} AS {self.identifier()}"
        return out

    def order(self) -> str:
        self.expect("ORDER")
        self.expect("BY")
        keys = []
        while True:
            key = self.expression()
            desc = self.is_word("DESC")
            if self.is_word("ASC", "DESC"):
                self.next()
            if not re.fullmatch(r"'.*'|NULL", key):
                keys.append(f"{key} DESC NULLS LAST" if desc else f"{key} ASC NULLS FIRST")
            if self.peek().text != ",":
                break
            self.next()
        return f"ORDER BY {', '.join(keys)}" if keys else ""

    # expressions, loosest first

    def expression(self) -> str:
        out = self.conjunction()
        while self.is_word("OR", "XOR"):
            op = self.next().text.upper()
            right = self.conjunction()
            out = f"({out} OR {right})" if op == "OR" else f"(({out}) <> ({right}))"
        return out

    def conjunction(self) -> str:
        out = self.negation()
        while self.is_word("AND"):
            self.next()
            out = f"({out} AND {self.negation()})"
        return out

    def negation(self) -> str:
        if self.is_word("NOT"):
            self.next()
            return f"(NOT {self.negation()})"
        return self.comparison()

    def comparison(self) -> str:
        out = self.joined_text()
        while True:
            t = self.peek()
            if t.kind == "op" and t.text in ("=", "<>", "!=", "<", "<=", ">", ">="):
                self.next()
                out = f"({out} {t.text} {self.joined_text()})"
            elif self.is_word("IS"):
                self.next()
                no = "NOT " if self.is_word("NOT") and self.next() else ""
                self.expect("NULL")
                out = f"({out} IS {no}NULL)"
            elif self.is_word("LIKE", "IN", "BETWEEN") or self.is_word("NOT") and self.is_word("LIKE", "IN", "BETWEEN", ahead=1):
                no = "NOT " if self.is_word("NOT") and self.next() else ""
                word = self.next().text.upper()
                if word == "LIKE" and self.has_class():
                    out = f"({out} {no}RLIKE {_quoted(class_pattern(self.next().text[1:-1].replace(chr(39) * 2, chr(39))))})"
                elif word == "LIKE":
                    out = f"({out} {no}LIKE {self.pattern()})"
                elif word == "BETWEEN":
                    low = self.joined_text()
                    self.expect("AND")
                    out = f"({out} {no}BETWEEN {low} AND {self.joined_text()})"
                elif self.peek().text == "(" and (self.is_word("SELECT", ahead=1) or self._nested_select()):
                    out = f"({out} {no}IN {self.parenthesised()})"
                else:
                    out = f"({out} {no}IN ({', '.join(self.arguments())}))"
            else:
                return out

    def has_class(self) -> bool:
        """Whether a literal pattern follows that holds a class of characters (``[a-c]``, ``[!x]``), which LIKE of Spark lacks."""
        t = self.peek()
        return t.kind == "text" and bool(re.search(r"\[[^\]]{2,}\]", t.text)) and not self.is_word("ESCAPE", ahead=1)

    def pattern(self) -> str:
        """Bracketed single characters (``[%]``) are literal ones."""
        t = self.peek()
        if t.kind == "text":
            self.next()
            body = re.sub(r"\[(.)\]", lambda m: "\\\\" + m[1] if m[1] in "%_" else m[1], t.text[1:-1].replace("''", "'"))
            out = _quoted(body, escape=False)
        else:
            out = self.joined_text()
        if self.is_word("ESCAPE"):
            self.next()
            out += f" ESCAPE {self.joined_text()}"
        return out

    def joined_text(self) -> str:
        out = self.bits()
        while self.peek().text == "&":
            self.next()
            out = f"concat(coalesce(cast({out} as string), ''), coalesce(cast({self.bits()} as string), ''))"
        return out

    def bits(self) -> str:
        out = self.sum()
        while self.is_word("BAND", "BOR", "BXOR"):
            op = {"BAND": "&", "BOR": "|", "BXOR": "^"}[self.next().text.upper()]
            out = f"({out} {op} {self.sum()})"
        return out

    def sum(self) -> str:
        out = self.remainder()
        while self.peek().kind == "op" and self.peek().text in "+-":
            op = self.next().text
            out = f"({out} {op} {self.remainder()})"
        return out

    def remainder(self) -> str:
        out = self.whole()
        while self.is_word("MOD"):
            self.next()
            out = f"({out} % {self.whole()})"
        return out

    def whole(self) -> str:
        out = self.product()
        while self.peek().text == "\\":
            self.next()
            out = f"({out} div {self.product()})"
        return out

    def product(self) -> str:
        out = self.unary()
        while self.peek().kind == "op" and self.peek().text in "*/":
            op = self.next().text
            out = f"({out} {op} {self.unary()})"
        return out

    def unary(self) -> str:
        if self.peek().text in ("-", "+") and self.peek().kind == "op":
            op = self.next().text
            return f"(-{self.unary()})" if op == "-" else self.unary()
        if self.is_word("BNOT"):
            self.next()
            return f"(~{self.unary()})"
        out = self.primary()
        while self.peek().text == "^":
            self.next()
            out = f"power({out}, {self.unary()})"
        return out

    def arguments(self) -> list[str]:
        self.expect("(")
        out = []
        while self.peek().text != ")":
            if self.peek().text == "*":
                self.next()
                out.append("*")
            elif self.is_word("SELECT"):
                out.append(f"({self.query()})")
            else:
                distinct = "DISTINCT " if self.is_word("DISTINCT") and self.next() else ""
                out.append(distinct + self.expression())
            if self.peek().text == ",":
                self.next()
        self.next()
        return out

    def primary(self) -> str:
        t = self.peek()
        if t.text == "(":
            if self.is_word("SELECT", ahead=1):
                return self.parenthesised()
            self.next()
            out = self.expression()
            self.expect(")")
            return f"({out})"
        if self.is_word("EXISTS"):
            self.next()
            return f"EXISTS {self.parenthesised()}"
        if self.is_word("CASE"):
            return self.case()
        self.next()
        if t.kind == "text":
            quote = t.text[0]
            return _quoted(t.text[1:-1].replace(quote * 2, quote))
        if t.kind == "date":
            body = t.text[1:-1].strip()
            return f"DATE'{body}'" if re.fullmatch(r"\d+-\d+-\d+", body) else f"TIMESTAMP'{body}'"
        if t.kind == "guid":
            return _quoted(t.text[1:-1])
        if t.kind == "bytes":
            return f"X'{t.text[2:]}'"
        if t.kind == "number":
            return t.text
        if t.kind == "param":
            return _value(self.argument(t))
        if t.kind == "global":
            raise DialectError(f"{t.text} can only be read by a store")
        if t.kind == "word" and t.text.upper() in ("TRUE", "FALSE", "NULL"):
            return t.text.upper()
        if t.kind == "word" and self.peek().text == "(":
            return self.function(t.text)
        if t.kind not in ("word", "name"):
            raise DialectError(f"unexpected {t.text!r}")
        self.at -= 1
        out = self.identifier()
        while self.peek().text == ".":
            self.next()
            out += ".*" if self.peek().text == "*" and self.next() else "." + self.identifier()
        return out

    def case(self) -> str:
        self.expect("CASE")
        out = "CASE"
        if not self.is_word("WHEN"):
            out += f" {self.expression()}"
        while self.is_word("WHEN"):
            self.next()
            when = self.expression()
            self.expect("THEN")
            out += f" WHEN {when} THEN {self.expression()}"
        if self.is_word("ELSE"):
            self.next()
            out += f" ELSE {self.expression()}"
        self.expect("END")
        return out + " END"

    def function(self, name: str) -> str:
        up = name.upper()
        a = self.arguments()
        if up == "IIF":
            return f"CASE WHEN {a[0]} THEN {a[1]} ELSE {a[2] if len(a) > 2 else 'NULL'} END"
        if up == "SWITCH":
            return "CASE " + " ".join(f"WHEN {c} THEN {v}" for c, v in zip(a[::2], a[1::2], strict=True)) + " END"
        if up == "INSTR":
            start, s, part = a[:3] if len(a) > 2 else ("1", *a)
            exact = len(a) > 3 and a[3] == "0"
            return f"locate({part}, {s}, {start})" if exact else f"locate(lower({part}), lower({s}), {start})"
        if up == "MID":
            return f"substring({', '.join(a)})"
        if up in ("LEFT", "RIGHT", "TRIM", "LTRIM", "RTRIM", "REPLACE"):
            return f"{up.lower()}({', '.join(a)})"
        if up == "CHR":
            return f"chr({a[0]})"
        if up in ("FIX", "INT"):
            return f"CAST(CASE WHEN {a[0]} < 0 THEN {'ceil' if up == 'FIX' else 'floor'}({a[0]}) ELSE floor({a[0]}) END AS double)"
        if up == "DATEPART":
            return f"extract({_PARTS[_bare(a[0])]} FROM {a[1]})"
        if up in ("YEAR", "MONTH", "DAY", "HOUR", "MINUTE", "SECOND"):
            return f"{up.lower()}({a[0]})"
        if up == "DATEADD":
            unit = {"y": "DAY", "w": "DAY", "ww": "WEEK"}.get(_bare(a[0])) or _PARTS[_bare(a[0])]
            return f"timestampadd({unit}, CAST({a[1]} AS int), {a[2]})"
        if up == "DATEDIFF":
            return _date_diff(_bare(a[0]), a[1], a[2])
        if up == "DATE" and not a:
            return "current_date()"
        if up == "DATESERIAL":
            return f"make_date({', '.join(a)})"
        if up in ("TIMEVALUE", "TIME"):
            x = f"CAST({a[0]} AS timestamp)"
            return f"(hour({x}) * 3600 + minute({x}) * 60 + second({x}))"
        if up == "TIMESERIAL":
            return f"({a[0]} * 3600 + {a[1]} * 60 + {a[2]})"
        if up == "CBYTE":
            x = f"bround(try_cast({a[0]} AS double))"
            return f"CASE WHEN {x} BETWEEN 0 AND 255 THEN CAST({x} AS smallint) END"
        if up in _CASTS:
            return f"try_cast(bround(try_cast({a[0]} AS double)) AS {_CASTS[up]})"
        if up in ("CSNG", "CDBL", "CDEC", "CCUR", "CDATE", "CSTR", "CBOOL"):
            kind = {"CSNG": "float", "CDBL": "double", "CDEC": "decimal(18,2)", "CCUR": "decimal(19,4)", "CDATE": "timestamp", "CSTR": "string"}.get(up)
            return f"try_cast({a[0]} AS {kind})" if kind else f"(try_cast({a[0]} AS double) <> 0)"
        if up == "CVAR":
            return a[0]
        if up == "ISDATE":
            return f"(try_to_timestamp({a[0]}) IS NOT NULL)"
        if up == "ISNULL":
            return f"({a[0]} IS NULL)"
        if up == "ASC":
            return f"ascii({a[0]})"
        if up == "SGN":
            return f"CAST(signum({a[0]}) AS int)"
        if up == "NOW":
            return "current_timestamp()"
        return f"{RENAMED.get(up, name)}({', '.join(a)})"


_CLAUSES = {"WHERE", "GROUP", "HAVING", "ORDER", "INNER", "LEFT", "RIGHT", "FULL", "CROSS", "JOIN", "ON", "UNION", "INTERSECT", "EXCEPT", "SKIP", "SET", "AS"}


def _quoted(s: str, escape: bool = True) -> str:
    return "'" + (s.replace("\\", "\\\\") if escape else s).replace("'", "\\'") + "'"


def class_pattern(pattern: str) -> str:
    """A LIKE pattern with classes of characters as a regular expression: ``[a-c]`` one of them, ``[!x]`` none of them."""
    out = ""
    for m in re.finditer(r"\[(!?)([^\]]+)\]|(.)", pattern, re.S):
        if m[2] is not None:
            out += f"[{'^' if m[1] else ''}" + re.sub(r"([\\\[\]^&])", r"\\\1", m[2]) + "]"
        else:
            out += {"%": ".*", "_": "."}.get(m[3]) or re.escape(m[3])
    return f"(?s)^{out}$"


def _bare(part: str) -> str:
    return part.strip("'").lower()


def _value(v: Any) -> str:
    import datetime as dt

    if v is None:
        return "NULL"
    if isinstance(v, bool):
        return str(v).upper()
    if isinstance(v, dt.datetime):
        return f"TIMESTAMP'{v:%Y-%m-%d %H:%M:%S}'"
    if isinstance(v, dt.date):
        return f"DATE'{v:%Y-%m-%d}'"
    if isinstance(v, (bytes, bytearray)):
        return f"X'{bytes(v).hex()}'"
    if isinstance(v, (list, tuple)):
        return ", ".join(map(_value, v)) or "NULL"
    return _quoted(v) if isinstance(v, str) else str(v)


def _date_diff(part: str, a: str, b: str) -> str:
    if part == "yyyy":
        return f"(year({b}) - year({a}))"
    if part == "q":
        return f"(4 * (year({b}) - year({a})) + quarter({b}) - quarter({a}))"
    if part == "m":
        return f"(12 * (year({b}) - year({a})) + month({b}) - month({a}))"
    if part in ("d", "y"):
        return f"datediff(to_date({b}), to_date({a}))"
    k = {"h": 3600, "n": 60, "s": 1}[part]
    return f"(floor(unix_seconds(CAST({b} AS timestamp)) / {k}) - floor(unix_seconds(CAST({a} AS timestamp)) / {k}))"


def translate(sql: str, args: dict | list | None = None) -> str:
    """Spark SQL for one SELECT of the dialect."""
    out, skip = _translated(sql, args)
    return out + (f" OFFSET {skip}" if skip else "")


def _translated(sql: str, args: dict | list | None) -> tuple[str, int]:
    """Spark SQL without a SKIP that ends the statement and has no TOP, and the rows it skips."""
    w = _Writer(tokenize(sql), args)
    out = w.query()
    if w.peek().kind != "end" and w.peek().text != ";":
        raise DialectError(f"unexpected {w.peek().text!r}")
    last = f" OFFSET {w.offset}"
    return (out.removesuffix(last), w.offset) if w.offset and out.endswith(last) else (out, 0)


def rows(spark: SparkSession, sql: str, args: dict | list | None = None) -> DataFrame:
    """The rows of one SELECT over the session's relations. OFFSET of a subquery is Spark's, through one task."""
    out, skip = _translated(sql, args)
    return rows_after(spark.sql(out), skip)


def translate_expression(sql: str, args: dict | list | None = None) -> str:
    w = _Writer(tokenize(sql), args)
    out = w.expression()
    if w.peek().kind != "end":
        raise DialectError(f"unexpected {w.peek().text!r}")
    return out


def run(spark: SparkSession, sql: str, args: dict | list | None = None, strict: bool = False, **tables: DataFrame) -> DataFrame:
    """One SELECT of the dialect; ``tables`` are the relations it may name beside the session's."""
    if strict:
        from quillon.plans.strict import check

        check(sql)
    for name, df in tables.items():
        df.createOrReplaceTempView(name)
    return rows(spark, sql, args)

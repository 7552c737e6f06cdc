"""Rule predicates as pairs of columns: a value, and an error that makes a rule unsupported.

A rule never fails because it can't be evaluated: a wrong type, a division by zero or an oversized
pattern yields an error, and the error wins over the value.  The pairs are plain Spark columns, so
Catalyst folds, prunes and compiles them like any other expression.

No operator repeats an operand's value in its own value (a lambda binds it where it is needed twice), nor
an error in its own error, and a null guard is only made for what can be null without an error.  So a value
is as large as the rule; an error, which asks values of what may be skipped, grows with the square of the
depth at most, and the depth has a budget.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

# Limits of the predicate language.
EPSILON = 2.220446049250313e-16
MAX_PATTERN_BYTES = 512
MAX_TEXT_BYTES = 4096
MAX_LIST = 65_536
MAX_DEPTH = 32
MAX_INSTRUCTIONS = 512
INT_MIN, INT_MAX = -(2**31), 2**31 - 1


def _none() -> Column:
    return F.lit(None).cast("string")


@dataclass(frozen=True)
class Checked:
    value: Column
    kind: str  # bool, number, string, list or null
    error: Column | None = None
    #: The value is null only where there is an error.
    sure: bool = False
    #: A literal or a property, which may be repeated.
    leaf: bool = False
    #: Nodes of the expression, and levels of them.
    nodes: int = 1
    depth: int = 1

    @property
    def err(self) -> Column:
        return _none() if self.error is None else self.error


def _made(value: Column, kind: str, error: Column | None, *operands: Checked, sure: bool = True) -> Checked:
    """An operator's result over *operands*."""
    return Checked(value, kind, error, sure, False, 1 + sum(x.nodes for x in operands), 1 + max((x.depth for x in operands), default=0))


def _bound(x: Checked, f: Callable[[Column], Column]) -> Column:
    """*f* of a value that it needs more than once."""
    return f(x.value) if x.leaf else F.get(F.transform(F.array(x.value), f), F.lit(0))


def lit(value) -> Checked:
    if value is None:
        return Checked(F.lit(None), "null", leaf=True)
    kind = "bool" if isinstance(value, bool) else "number" if isinstance(value, (int, float)) else "list" if isinstance(value, list) else "string"
    if kind == "number":
        return Checked(F.lit(float(value)), kind, sure=True, leaf=True)
    return Checked(F.array(*map(F.lit, value)) if kind == "list" else F.lit(value), kind, sure=True, leaf=True)


def prop(column, kind: str) -> Checked:
    """A property of an object; an absent one is null.  Numbers are doubles."""
    column = F.col(column) if isinstance(column, str) else column
    return Checked(column.cast("double") if kind == "number" else column, kind, leaf=True)


def unsupported(reason: str) -> Checked:
    return Checked(F.lit(None).cast("boolean"), "bool", F.lit(reason), sure=True, leaf=True)


def over_budget(test: Checked) -> str | None:
    """The budget that an expression exceeds whatever object it meets, if any: its depth or its nodes."""
    if test.depth > MAX_DEPTH:
        return "budget exceeded: depth"
    return "budget exceeded: instructions" if test.nodes > MAX_INSTRUCTIONS else None


def has_parse_fact(facts: str | Column, name: str) -> Checked:
    """Whether a document's parse facts, an array of structs (kind, declared, discovered), have one by this name.

    Known are ``header``, ``encryption`` (a fact of that kind that says so: ``encrypted``) and
    ``streamLengthMismatch`` (a stream whose declared length isn't the one found); any other name has none.
    """
    column = F.col(facts) if isinstance(facts, str) else facts
    tests = {
        "header": lambda f: f["kind"] == "header",
        "encryption": lambda f: f["kind"] == "encrypted",
        "streamLengthMismatch": lambda f: (f["kind"] == "streamLength") & ~f["declared"].eqNullSafe(f["discovered"]),
    }
    found = F.exists(F.coalesce(column, F.array().cast("array<struct<kind:string,declared:bigint,discovered:bigint>>")), tests[name]) if name in tests else F.lit(False)
    return Checked(F.coalesce(found, F.lit(False)), "bool", None, True)


def _first_error(*errors: Column | None) -> Column | None:
    present = [e for e in errors if e is not None]
    return F.coalesce(*present) if len(present) > 1 else present[0] if present else None


def _wrong(kind: str, *sides: Checked) -> Column | None:
    """An error where a side isn't of *kind*; null values are of no kind."""
    if any(s.kind != kind for s in sides):
        return F.lit(f"type mismatch: {kind} expected")
    missing = None
    for s in sides:
        if not s.sure:
            missing = s.value.isNull() if missing is None else missing | s.value.isNull()
    return None if missing is None else F.when(missing, F.lit(f"type mismatch: {kind} expected"))


def _equal(a: Checked, b: Checked) -> Column:
    if "null" in (a.kind, b.kind):
        return a.value.isNull() & b.value.isNull()
    if a.kind != b.kind:
        return F.lit(False) if a.sure or b.sure else a.value.isNull() & b.value.isNull()
    if a.kind != "number":
        return a.value.eqNullSafe(b.value)
    close = lambda x, y: F.abs(x - y) < EPSILON
    if a.sure or b.sure:  # one of them may be null, which nothing equals
        return F.coalesce(close(a.value, b.value), F.lit(False))
    return _bound(a, lambda x: _bound(b, lambda y: F.coalesce(close(x, y), x.isNull() & y.isNull())))


def eq(a: Checked, b: Checked) -> Checked:
    """Null equals null; other kinds never equal each other; numbers are equal within epsilon."""
    return _made(_equal(a, b), "bool", _first_error(a.error, b.error), a, b)


def ne(a: Checked, b: Checked) -> Checked:
    return _made(~_equal(a, b), "bool", _first_error(a.error, b.error), a, b)


def _numbers(a: Checked, b: Checked, value: Column, kind: str, more: Column | None = None) -> Checked:
    wrong = _wrong("number", a, b)
    if "number" != a.kind or "number" != b.kind:
        return _made(F.lit(None).cast("boolean" if kind == "bool" else "double"), kind, _first_error(a.error, b.error, wrong), a, b)
    return _made(value, kind, _first_error(a.error, b.error, wrong, more), a, b)


def lt(a: Checked, b: Checked) -> Checked:
    return _numbers(a, b, a.value < b.value, "bool")


def le(a: Checked, b: Checked) -> Checked:
    return _numbers(a, b, a.value <= b.value, "bool")


def gt(a: Checked, b: Checked) -> Checked:
    return _numbers(a, b, a.value > b.value, "bool")


def ge(a: Checked, b: Checked) -> Checked:
    return _numbers(a, b, a.value >= b.value, "bool")


def add(a: Checked, b: Checked) -> Checked:
    return _numbers(a, b, a.value + b.value, "number")


def sub(a: Checked, b: Checked) -> Checked:
    return _numbers(a, b, a.value - b.value, "number")


def mul(a: Checked, b: Checked) -> Checked:
    return _numbers(a, b, a.value * b.value, "number")


def _divided(a: Checked, b: Checked, remainder: bool) -> Checked:
    if a.kind != "number" or b.kind != "number":
        return _numbers(a, b, a.value, "number")
    zero = F.when(F.abs(b.value) < EPSILON, F.lit("division by zero"))
    # null for a zero, so nothing is raised in ANSI mode
    return _numbers(a, b, F.try_mod(a.value, b.value) if remainder else F.try_divide(a.value, b.value), "number", zero)


def div(a: Checked, b: Checked) -> Checked:
    return _divided(a, b, False)


def rem(a: Checked, b: Checked) -> Checked:
    """Remainder with the sign of the dividend."""
    return _divided(a, b, True)


def _whole(x: Checked) -> Column:
    """A 32-bit integer, null for a number that isn't one."""
    return _bound(x, lambda v: F.when(v.between(INT_MIN, INT_MAX) & (F.floor(v) == v), v).cast("bigint"))


def _not_whole(*sides: Checked) -> Column:
    missing = _whole(sides[0]).isNull()
    for x in sides[1:]:
        missing = missing | _whole(x).isNull()
    return F.when(missing, F.lit("not an integer"))


def bit_and(a: Checked, b: Checked) -> Checked:
    if a.kind != "number" or b.kind != "number":
        return _numbers(a, b, a.value, "number")
    return _numbers(a, b, _whole(a).bitwiseAND(_whole(b)).cast("double"), "number", _not_whole(a, b))


def shift_right(a: Checked, b: Checked) -> Checked:
    """Arithmetic shift by 0 to 63 bits."""
    if a.kind != "number" or b.kind != "number":
        return _numbers(a, b, a.value, "number")
    outside = F.when(_bound(b, lambda v: ~v.between(0, 63)), F.lit("shift out of range"))
    shifted = F.call_function("shiftright", _whole(a), _whole(b).cast("int"))
    return _numbers(a, b, shifted.cast("double"), "number", F.coalesce(_not_whole(a, b), outside))


def not_(a: Checked) -> Checked:
    return _made(~a.value if a.kind == "bool" else F.lit(None).cast("boolean"), "bool", _first_error(a.error, _wrong("bool", a)), a)


def _bool(a: Checked) -> Checked:
    value = a.value if a.kind == "bool" else F.lit(None).cast("boolean")
    return Checked(value, "bool", _first_error(a.error, _wrong("bool", a)), True, a.leaf, a.nodes, a.depth)


def _either(terms: Sequence[Checked], stop: bool) -> Checked:
    """Left to right up to the first term that is *stop*; what follows it isn't evaluated, nor are its errors."""
    if not terms:
        return lit(not stop)
    done = _bool(terms[-1])
    for term in reversed(terms[:-1]):
        done = _joined(term, done, stop)
    return done


def _joined(first: Checked, rest: Checked, stop: bool) -> Checked:
    term = _bool(first)
    goes_on = ~term.value if stop else term.value
    value = F.when(goes_on, rest.value).otherwise(F.lit(stop))
    later = None if rest.error is None else F.when(goes_on, rest.error)
    return _made(value, "bool", _first_error(term.error, later), term, rest)


def and_(*terms: Checked) -> Checked:
    return _either(terms, False)


def or_(*terms: Checked) -> Checked:
    return _either(terms, True)


def all_(*terms: Checked) -> Checked:
    return and_(*terms)


def exists_(*terms: Checked) -> Checked:
    return or_(*terms)


def choose(condition: Checked, yes: Checked, no: Checked) -> Checked:
    """``condition ? yes : no``; only the branch taken counts."""
    c = _bool(condition)
    kind = yes.kind if no.kind == "null" else no.kind
    branch = None if yes.error is None and no.error is None else F.when(c.value, yes.err).otherwise(no.err)
    return _made(F.when(c.value, yes.value).otherwise(no.value), kind, _first_error(c.error, branch), c, yes, no, sure=yes.sure and no.sure)


# Strings and lists.  Positions and sizes of strings are in UTF-8 bytes and begin at 0.


def size(a: Checked) -> Checked:
    length = F.octet_length(a.value) if a.kind == "string" else F.size(a.value) if a.kind == "list" else F.lit(None)
    wrong = _wrong(a.kind if a.kind in ("string", "list") else "string", a)
    return _made(length.cast("double"), "number", _first_error(a.error, wrong), a)


def is_empty(a: Checked) -> Checked:
    return eq(size(a), lit(0))


def contains(a: Checked, b: Checked) -> Checked:
    """A part of a string, or a member of a list."""
    if a.kind == "list":
        return _made(F.array_contains(a.value, b.value), "bool", _first_error(a.error, b.error, _wrong("list", a)), a, b, sure=False)
    return _made(F.contains(a.value, b.value) if a.kind == b.kind == "string" else F.lit(None).cast("boolean"), "bool", _first_error(a.error, b.error, _wrong("string", a, b)), a, b)


def _pattern_error(pattern: str) -> str | None:
    """Look-around and back-references are refused, as is a pattern that is too long."""
    if len(pattern.encode()) > MAX_PATTERN_BYTES:
        return "pattern too long"
    if re.search(r"\(\?(?:[=!]|<[=!])|\\[1-9]", pattern):
        return "pattern not supported"
    return None


def _too_long(a: Checked) -> Column:
    return F.when(F.octet_length(a.value) > MAX_TEXT_BYTES, F.lit("text too long"))


def _short(a: Checked) -> Column:
    return _bound(a, lambda v: F.when(F.octet_length(v) <= MAX_TEXT_BYTES, v))


def matches(a: Checked, pattern: str) -> Checked:
    """Whether the pattern is found anywhere in a text of at most 4,096 bytes."""
    if bad := _pattern_error(pattern):
        return unsupported(bad)
    return _made(F.rlike(_short(a), F.lit(pattern)), "bool", _first_error(a.error, _wrong("string", a), _too_long(a)), a)


def split(a: Checked, separator: str) -> Checked:
    """Parts between literal separators, empty ones included."""
    if not separator:
        return Checked(F.lit(None).cast("array<string>"), "list", F.lit("empty separator"), True)
    parts = F.split(a.value, re.escape(separator), -1)
    return _made(parts, "list", _first_error(a.error, _wrong("string", a), F.when(F.size(parts) > MAX_LIST, F.lit("list too long"))), a)


def filter_equals(a: Checked, *values: str) -> Checked:
    return _made(F.filter(a.value, lambda x: x.isin(*values)), "list", _first_error(a.error, _wrong("list", a)), a)


def filter_not_equals(a: Checked, *values: str) -> Checked:
    return _made(F.filter(a.value, lambda x: ~x.isin(*values)), "list", _first_error(a.error, _wrong("list", a)), a)


def _filter_pattern(a: Checked, pattern: str, wanted: bool) -> Checked:
    """Members that match, or don't; a member of more than 4,096 bytes is an error."""
    if bad := _pattern_error(pattern):
        return Checked(F.lit(None).cast("array<string>"), "list", F.lit(bad), True)
    short = lambda x: F.when(F.octet_length(x) <= MAX_TEXT_BYTES, x)
    hit = (lambda x: F.rlike(short(x), F.lit(pattern))) if wanted else (lambda x: ~F.rlike(short(x), F.lit(pattern)))
    long = F.when(F.exists(a.value, lambda x: F.octet_length(x) > MAX_TEXT_BYTES), F.lit("text too long"))
    return _made(F.filter(a.value, hit), "list", _first_error(a.error, _wrong("list", a), long if a.kind == "list" else None), a)


def filter_matches(a: Checked, pattern: str) -> Checked:
    return _filter_pattern(a, pattern, True)


def filter_not_matches(a: Checked, pattern: str) -> Checked:
    return _filter_pattern(a, pattern, False)


def slice_(a: Checked, start: int) -> Checked:
    """A list without its first members; a string from a byte on, empty if that is outside or within a character."""
    if a.kind == "list":
        rest = _bound(a, lambda v: F.slice(v, start + 1, F.greatest(F.size(v) - start, F.lit(0))))
        return _made(rest, "list", _first_error(a.error, _wrong("list", a)), a)
    bytes_ = lambda v: F.substring(F.encode(v, "UTF-8"), start + 1, 2**31 - 1)
    rest = _bound(a, lambda v: F.when(F.is_valid_utf8(bytes_(v).cast("string")), F.decode(bytes_(v), "UTF-8")).otherwise(F.lit("")))
    return _made(rest, "string", _first_error(a.error, _wrong("string", a)), a)


def _byte_position(text: Checked, at: Callable[[Column], Column]) -> Column:
    """Bytes before a character position (1 is the first, 0 none) of a text; -1 for none."""
    return _bound(text, lambda v: F.when(at(v) > 0, F.octet_length(F.left(v, at(v) - 1))).otherwise(F.lit(-1)).cast("double"))


def index_of(a: Checked, b: Checked) -> Checked:
    """Byte position in a string or place in a list, -1 where absent."""
    if a.kind == "list":
        return _made((F.array_position(a.value, b.value) - 1).cast("double"), "number", _first_error(a.error, b.error, _wrong("list", a)), a, b, sure=False)
    at = _bound(b, lambda w: _byte_position(a, lambda v: F.instr(v, w)))
    return _made(at, "number", _first_error(a.error, b.error, _wrong("string", a, b)), a, b)


def find_index_equals(a: Checked, *values: str) -> Checked:
    """Place of the first member that is one of *values*, -1 where there is none."""
    hits = F.transform(a.value, lambda x: F.coalesce(x.isin(*values), F.lit(False)))
    return _made((F.array_position(hits, True) - 1).cast("double"), "number", _first_error(a.error, _wrong("list", a)), a)


def search(a: Checked, pattern: str) -> Checked:
    """Byte position of the first match in a text of at most 4,096 bytes, -1 where there is none."""
    if bad := _pattern_error(pattern):
        return Checked(F.lit(None).cast("double"), "number", F.lit(bad), True)
    short = Checked(_short(a), a.kind, leaf=a.leaf)
    return _made(_byte_position(short, lambda v: F.regexp_instr(v, F.lit(pattern))), "number", _first_error(a.error, _wrong("string", a), _too_long(a)), a)


def abs_(a: Checked) -> Checked:
    return _made(F.abs(a.value) if a.kind == "number" else F.lit(None).cast("double"), "number", _first_error(a.error, _wrong("number", a)), a)


def outcome(test: Checked) -> Column:
    """``passed``, ``failed`` or, where the test has an error or no boolean value, ``unsupported``."""
    t = _bool(test)
    return F.when(t.err.isNotNull(), F.lit("unsupported")).when(t.value, F.lit("passed")).otherwise(F.lit("failed"))


def error(test: Checked) -> Column:
    return _bool(test).err

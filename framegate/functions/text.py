"""Column expressions over text."""

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space as Python's str.strip and str.split see it.
BLANK = "[\\s\\x1c-\\x1f\\x85\\u00a0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000]"


def stripped(c: Column) -> Column:
    return F.regexp_replace(c, f"^{BLANK}+|{BLANK}+$", "")


def state_key(c: Column) -> Column:
    """A state name in comparable form: outer blanks off, lower case, hyphens and runs of blanks as one underscore each."""
    return F.regexp_replace(F.regexp_replace(F.lower(stripped(c)), "-", "_"), f"{BLANK}+", "_")


def vocabulary_key(c: Column) -> Column:
    """A category or risk in comparable form: lower case without outer blanks, each hyphen and blank an underscore."""
    return F.regexp_replace(F.lower(stripped(c)), f"-|{BLANK}", "_")


def relative_path(c: Column) -> Column:
    """The path that a relative spelling resolves to: no empty or '.' steps, '..' takes the step before it away."""

    def step(done: Column, part: Column) -> Column:
        up = (F.size(done) > 0) & (F.element_at(done, -1) != "..")
        return F.when(part.isin("", "."), done).when((part == "..") & up, F.slice(done, 1, F.size(done) - 1)).otherwise(F.concat(done, F.array(part)))

    plain = F.array_join(F.aggregate(F.split(c, "/"), F.array().cast("array<string>"), step), "/")
    return F.when(c.rlike(r"(^|/)\.{1,2}(/|$)|//|^/|/$"), plain).otherwise(c)

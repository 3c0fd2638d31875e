"""What an interpreter's run leaves behind: JSON lines with usage and session, and a structured answer."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_USAGE = ("input_tokens", "cached_input_tokens", "output_tokens", "reasoning_output_tokens")
VERIFICATIONS = ("confirmed", "not_confirmed", "uncertain", "not_applicable")


def _lines(df: DataFrame, key: str, log: str) -> DataFrame:
    return df.select(key, F.posexplode(F.split(log, "\n")).alias("_pos", "_line"))


def _count(path: str) -> Column:
    """A whole number of at least 0; text, truth values, fractions and negatives are not."""
    raw = F.get_json_object("_line", path)
    quoted = F.get_json_object("_line", path.rpartition(".")[0]).rlike('"' + path.rpartition(".")[2] + r'"\s*:\s*"')
    return F.when(raw.rlike("^[0-9]{1,18}$") & ~F.coalesce(quoted, F.lit(False)), raw.cast("long"))


def last_usage(df: DataFrame, key: str, log: str) -> DataFrame:
    """Token counts of the last valid completed turn of each log; nulls if there is none. Lines that are no JSON are skipped; a record
    needs both input and output, and any other count in it must be valid too."""
    lines = _lines(df, key, log)
    counts = {u: _count(f"$.usage.{u}") for u in _USAGE}
    there = lambda u: F.get_json_object("_line", f"$.usage.{u}").isNotNull()
    ok = (F.get_json_object("_line", "$.type") == "turn.completed") & counts["input_tokens"].isNotNull() & counts["output_tokens"].isNotNull()
    for u in ("cached_input_tokens", "reasoning_output_tokens"):
        ok = ok & (~there(u) | counts[u].isNotNull())
    best = lines.groupBy(key).agg(F.max(F.when(F.coalesce(ok, F.lit(False)), F.struct("_pos", *[c.alias(u) for u, c in counts.items()]))).alias("_u"))
    return best.select(key, *[F.col(f"_u.{u}").alias(u) for u in _USAGE]).where("input_tokens is not null")


def session_id(df: DataFrame, key: str, log: str) -> DataFrame:
    """The first thread started in each log, if its id is not blank; columns key, session_id."""
    lines = _lines(df, key, log)
    thread = F.get_json_object("_line", "$.thread_id")
    ok = (F.get_json_object("_line", "$.type") == "thread.started") & (F.trim(thread) != "")
    return lines.groupBy(key).agg(F.min_by(F.when(ok, thread), F.when(ok, F.col("_pos"))).alias("session_id"))


ANSWER = "state string, summary string, relevant boolean, confidence double, recommended_action string, verification string, evidence array<string>"


def parse_answers(df: DataFrame, key: str, text: str) -> DataFrame:
    """Structured answers with an `error` where a field is missing or out of range; columns key, ANSWER's fields, error."""
    rows = df.select(key, F.from_json(text, ANSWER, {"mode": "PERMISSIVE"}).alias("a"), F.col(text).alias("_t"))
    missing = lambda f: F.get_json_object("_t", f"$.{f}").isNull()
    names = [f.split()[0] for f in ANSWER.split(", ")]
    error = F.when(F.get_json_object("_t", "$").isNull(), "not an object")
    for f in names:
        error = error.when(missing(f), f"{f} is missing").when(F.col(f"a.{f}").isNull(), f"{f} has the wrong type")
    error = error.when(~F.col("a.confidence").between(0, 1), "confidence is not in [0, 1]").when(~F.col("a.verification").isin(*VERIFICATIONS), "unknown verification")
    return rows.select(key, "a.*", error.alias("error"))

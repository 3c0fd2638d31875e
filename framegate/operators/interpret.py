"""Everything around an interpreter: what it is told, what its answers must look like, and what is known of it."""

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from framegate.sources.logs import ANSWER, VERIFICATIONS

#: An interpreter takes an event (a dict, with its images if they were joined) and the state it gave last, and gives a dict with state and verification.
#: It may have metadata(), a dict that goes into reports.
Interpreter = Callable[[dict, str | None], dict]
_JSON = {"string": "string", "double": "number", "boolean": "boolean"}


def metadata(interpreter: Interpreter | None) -> dict:
    """What reports say of an interpreter: its name, and what its metadata() adds, which must be a dict."""
    if interpreter is None:
        return {"name": "none"}
    own = getattr(interpreter, "metadata", None)
    more = own() if callable(own) else {}
    if not isinstance(more, dict):
        raise ValueError("metadata() of an interpreter must give a dict")
    return {"name": getattr(interpreter, "__name__", type(interpreter).__name__), **more}


def answer_schema() -> dict:
    """The JSON schema of a structured answer, from the columns that parse_answers() reads."""
    fields = {}
    for f in T._parse_datatype_string(ANSWER).fields:
        array = isinstance(f.dataType, T.ArrayType)
        fields[f.name] = {"type": "array", "items": {"type": "string"}} if array else {"type": _JSON[f.dataType.typeName()]}
    fields["confidence"] |= {"minimum": 0, "maximum": 1}
    fields["verification"] |= {"enum": list(VERIFICATIONS)}
    return {"type": "object", "properties": fields, "required": list(fields), "additionalProperties": False}


def with_prompt(events: DataFrame, goal: str, name: str = "prompt") -> DataFrame:
    """events with a text that tells an interpreter what it sees: the goal, the event, its region in pixels, the action and what was expected of it. A line
    whose facts an event lacks is left out."""
    number = lambda form, *c: F.when(F.col(c[0]).isNotNull(), F.format_string(form, *map(F.col, c)))
    lines = [
        F.lit(f"Goal: {goal}"),
        number("Event %d at %.3f s: %s", "sequence_no", "timestamp_s", "reason"),
        number("Changed share of the frame: %.8f, found by %s", "change_fraction", "discovery"),
        number("Region in pixels: x %d, y %d, width %d, height %d", "x", "y", "width", "height"),
        number("Strongest change at %.3f s", "peak_timestamp"),
        number("Action taken: %s", "action_text"),
        number("Expected after it: %s", "expected_result"),
        F.lit(f"Answer with one JSON object; verification is one of {', '.join(VERIFICATIONS)}."),
    ]
    return events.withColumn(name, F.concat_ws("\n", *lines))


def with_images(events: DataFrame, images: DataFrame) -> DataFrame:
    """events with `images`: an array of (position, role, width, height, data), four at most. images: as from operators.frames.event_images."""
    one = F.struct("position", "role", "width", "height", "data")
    shown = images.groupBy("media_id", "sequence_no").agg(F.array_sort(F.collect_list(one), lambda a, b: a["position"] - b["position"]).alias("images"))
    return events.join(shown, ["media_id", "sequence_no"], "left")


def interpreted(events: DataFrame, interpret: Interpreter) -> DataFrame:
    """events with state and verification from a user's function, called in order per medium with the state it gave last. Images are passed on to the
    function, not to the result."""
    columns = [f for f in events.schema.fields if f.name != "images"]
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in columns) + ", state string, verification string"
    names = [f.name for f in columns]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        media, last = None, None
        for batch in batches:
            answers = []
            for row in batch.to_dict("records"):
                if row["media_id"] != media:
                    media, last = row["media_id"], None
                answer = interpret(row, last)
                last = answer.get("state")
                answers.append((last, answer.get("verification")))
            yield batch[names].assign(state=[a for a, _ in answers], verification=[b for _, b in answers])

    return events.repartition("media_id").sortWithinPartitions("media_id", "sequence_no").mapInPandas(run, schema)

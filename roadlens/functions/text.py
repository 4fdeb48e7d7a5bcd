"""Label and text rules."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Labels and patterns of the log format.
SENTINELS = ("StartPoint", "Start", "None", "Termination", "EndPoint")
NO_EVENT = "None"
RECORD_TYPES = {
    "gps": "GPS",
    "cartelemetries": "Car_Telemetries",
    "cartelemetry": "Car_Telemetries",
    "telemetries": "Car_Telemetries",
    "termination": "Termination",
}
CATEGORIES = (
    (r"\b(startpoint|endpoint)\b", "SimulationPoints"),
    (r"\bwalker\s*\d*\b", "Pedestrians"),
    (r"\bovertake\b", "Overtake"),
    (r"\btraffic light\s*\d*\b", "TrafficLights"),
    (r"\bgap acceptance\b", "GapAcceptance"),
)
POLICE_CAR = r"vehicle\.dodge\.charger_police"
GAP_EVENT = "egocar gap acceptance"
ACCOMPANIER_WORDS = ("מלווה", "accompanier")


def strip(c: Column) -> Column:
    """Trim every kind of white space, not only blanks."""
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def is_blank(c: Column) -> Column:
    """True for null and for white space only."""
    return c.isNull() | (strip(c) == "")


def normalize_type(c: Column) -> Column:
    """Canonical record type; unknown spellings stay as they are."""
    key = F.translate(F.lower(strip(c)), " _", "")
    known = F.create_map(*[F.lit(x) for pair in RECORD_TYPES.items() for x in pair])
    return F.coalesce(known[key], c)


def clean_event(c: Column) -> Column:
    """Event name without its start/end word; sentinels stay untouched."""
    words = F.regexp_replace(F.lower(strip(c)), r"\b(start|end)\b", "")
    plain = F.regexp_replace(words, r"[^a-zA-Z0-9\s]", "")
    return F.when(c.isin(*SENTINELS), c).otherwise(strip(F.regexp_replace(plain, r"\s+", " ")))


def strip_leading_start_end(c: Column) -> Column:
    """Drop one leading Start/End word, keep the case of the rest."""
    return strip(F.regexp_replace(strip(c), r"(?i)^(start|end)\s+", ""))


def feedback_event(c: Column) -> Column:
    """Event label used to group feedback: no leading [egocar] start/end, lower case."""
    return F.lower(strip(F.regexp_replace(strip(c), r"(?i)^(egocar\s+)?(start|end)\s+", "")))


def match_label(c: Column) -> Column:
    """Event text looked for inside frame labels: without start, end and egocar."""
    bare = strip(F.regexp_replace(c, r"(?i)\b(start|end|egocar)\b", ""))
    return F.regexp_replace(bare, r"\s{2,}", " ")


def categorize(c: Column) -> Column:
    """Category of an event label: the first pattern that occurs in it."""
    label = F.lower(strip(c))
    out = F.lit(None).cast("string")
    for pattern, name in reversed(CATEGORIES):
        out = F.when(label.rlike(pattern), F.lit(name)).otherwise(out)
    return out


def normalize_walker(c: Column) -> Column:
    """Bare ``walker N`` / ``pedestrian N`` become ``section walkerN``."""
    bare = strip(c)
    form = r"(?i)^(walker|pedestrian)\s*(\d+)$"
    return F.when(bare.rlike(form), F.regexp_replace(bare, form, "section walker$2")).otherwise(c)


_LIGHT = r"(start|end)?\s*traffic\s*light\s*(\d+)"


def light_number(c: Column) -> Column:
    """Number of the traffic light named in an event, else null."""
    return F.nullif(F.regexp_extract(F.lower(c), _LIGHT, 2), F.lit("")).try_cast("long")


def light_event_kind(c: Column) -> Column:
    """``start``, ``end`` or ``entry`` for traffic-light events, else null."""
    kind = F.nullif(F.regexp_extract(F.lower(c), _LIGHT, 1), F.lit(""))
    return F.when(light_number(c).isNotNull(), F.coalesce(kind, F.lit("entry")))


def event_key(id_: Column, condition: Column, event: Column) -> Column:
    """Lower-case key of a traffic-light event, null for other events."""
    name = strip_leading_start_end(event)
    key = F.lower(F.concat_ws("__", id_, condition, name))
    return F.when(F.lower(name).contains("traffic light"), key)


def comment_flag(c: Column) -> Column:
    """1 where there is text."""
    return F.when(is_blank(c), 0).otherwise(1)


def is_real_event(c: Column) -> Column:
    """Non-blank and no sentinel, in any case; never null."""
    return ~is_blank(c) & ~F.lower(strip(c)).isin(*[s.lower() for s in SENTINELS])


def is_accompanier(c: Column) -> Column:
    """Speaker unknown or named as the accompanier."""
    s = F.lower(strip(c))
    named = F.lit(False)
    for word in ACCOMPANIER_WORDS:
        named = named | s.contains(word)
    return is_blank(c) | (s == "nan") | named

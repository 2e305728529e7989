"""Mixed timestamp formats and zones to one instant (microseconds since 1970 UTC)."""

from __future__ import annotations

import zoneinfo
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Month names and abbreviations in English, Spanish and Portuguese, January to December.
MONTH_NAMES = (
    "january jan enero ene janeiro", "february feb febrero fevereiro fev", "march mar marzo março marco", "april apr abril abr", "may mayo maio mai", "june jun junio junho",
    "july jul julio julho", "august aug agosto ago", "september sept sep septiembre setiembre set setembro", "october oct octubre outubro out", "november nov noviembre novembro", "december dec diciembre dic dezembro dez",
)
MONTHS = {name: i + 1 for i, names in enumerate(MONTH_NAMES) for name in names.split()}
#: Names and abbreviations of weekdays in the same languages.
WEEKDAYS = (
    "monday mon tuesday tue tues wednesday wed thursday thu thur thurs friday fri saturday sat sunday sun lunes lun martes mar miércoles miercoles mié mie jueves jue viernes vie sábado sabado sáb sab domingo dom "
    "segunda seg terça terca ter quarta qua quinta qui sexta sex segunda-feira terça-feira terca-feira quarta-feira quinta-feira sexta-feira"
).split()

#: Zone abbreviations and their minutes east of UTC.
ZONES = {
    "z": 0, "gmt": 0, "utc": 0, "ut": 0, "wet": 0, "west": 60, "bst": 60, "cet": 60, "cest": 120, "eet": 120, "eest": 180,
    "est": -300, "edt": -240, "cst": -360, "cdt": -300, "mst": -420, "mdt": -360, "pst": -480, "pdt": -420,
    "bot": -240, "pet": -300, "cot": -300, "clt": -240, "clst": -180, "art": -180, "brt": -180, "brst": -120, "vet": -240,
    "jst": 540, "hkt": 480, "sgt": 480,
}

_TIME = r"(\d{1,2}):(\d{2})(?::(\d{2})(?:[.,](\d+))?)?"
_HALF = r"(?: ?(a|p)\.? ?m\.?)?"
_OFFSET = r"[+-]\d{2}(?::?\d{2})?"
_MONTH = "(" + "|".join(sorted(MONTHS, key=len, reverse=True)) + r")\.?"
_WEEKDAY = "(?:(?:" + "|".join(sorted(WEEKDAYS, key=len, reverse=True)) + r")\.?,? )?"
#: A zone: an abbreviation, an offset with or without UTC before it, or a name of the IANA database; a comment may follow.
_ZONE = rf"(?: ?\[?(z|[a-z]{{2,5}}|(?:utc|gmt)?{_OFFSET}|(?:utc|gmt)[+-]\d{{1,2}}|[a-z_]+/[a-z_/]+)\]?)?(?: ?\([a-z ]{{1,40}}\))?"

#: Forms of a time, each with its rewriting to year|month|day|hour|minute|second|fraction|half|zone.
FORMS = [
    # 2024-03-05, 2024-03-05T10:20:30.123-04:00, 2024-03-05 10:20:30 BOT, 2024-03-05 10:20 UTC-4, 2024/03/05 10:20 America/La_Paz
    (rf"^(\d{{4}})[-/](\d{{2}})[-/](\d{{2}})(?:[t ]{_TIME}{_HALF})?{_ZONE}$", "$1|$2|$3|$4|$5|$6|$7|$8|$9"),
    # 20240305, 20240305T102030-0400
    (rf"^(\d{{4}})(\d{{2}})(\d{{2}})(?:t(\d{{2}})(\d{{2}})(\d{{2}})(?:[.,](\d+))?(z|{_OFFSET})?)?$", "$1|$2|$3|$4|$5|$6|$7||$8"),
    # Tue, 05 Mar 2024 10:20:30 GMT; Tuesday, 05-Mar-24 10:20:30 GMT; 05 MAR 2024 10:20:30 UTC; 5 mar 2024, 10:20 h; 5 March 2024
    (rf"^{_WEEKDAY}(\d{{1,2}})[ -]{_MONTH}[ -](\d{{4}}|\d{{2}})(?:,? {_TIME}{_HALF}(?: ?(?:hrs|h))?)?{_ZONE}$", "$3|$2|$1|$4|$5|$6|$7|$8|$9"),
    # Tue Mar  5 10:20:30 2024
    (rf"^{_WEEKDAY}{_MONTH} (\d{{1,2}}) {_TIME} (\d{{4}})$", "$7|$1|$2|$3|$4|$5|$6||"),
    # 05/03/2024, 5/3/2024 10:20:30, 05.03.2024 10:20, 3/5/2024 10:20 AM
    (rf"^(\d{{1,2}})[/.-](\d{{1,2}})[/.-](\d{{4}})(?:,? {_TIME}{_HALF})?{_ZONE}$", "$3|$2|$1|$4|$5|$6|$7|$8|$9"),
    # martes, 5 de marzo de 2024, 10:20 hrs; 5 de março de 2024 às 10h20; 5 de marzo del 2024 - 10:20 p. m.
    (rf"^{_WEEKDAY}(\d{{1,2}}) de {_MONTH} del? (\d{{4}})(?:(?:,| -| às| a las)? (\d{{1,2}})[:h](\d{{2}})(?::(\d{{2}}))?{_HALF}(?: ?(?:hrs|h))?\.?)?{_ZONE}$", "$3|$2|$1|$4|$5|$6||$7|$8"),
    # March 5, 2024 10:20 PM; Tuesday, Mar 5 2024; March 5, 2024 at 10:20 AM
    (rf"^{_WEEKDAY}{_MONTH} (\d{{1,2}}),? (\d{{4}})(?:(?:,| at)? {_TIME}{_HALF})?{_ZONE}$", "$3|$1|$2|$4|$5|$6|$7|$8|$9"),
]


#: The form whose day and month the language may swap, where they stand between strokes or hyphens.
FLEXIBLE = 4
#: Minutes east of UTC that a written offset may have.
OFFSETS = (-12 * 60, 14 * 60)


def _lookup(key: Column, values: dict[str, int]) -> Column:
    return F.element_at(F.create_map(*(F.lit(x) for pair in values.items() for x in pair)), key)


def _zone_names() -> Column:
    """IANA zone names by their lower-case form."""
    names = sorted(z for z in zoneinfo.available_timezones() if "/" in z)
    return F.map_from_arrays(F.array(*(F.lit(z.lower()) for z in names)), F.array(*map(F.lit, names)))


def read_times(rows: DataFrame, raw: str, lang: str | None) -> DataFrame:
    """Parse the written times of column ``raw``; adds ``us``, ``offset_min`` and ``named``.

    ``us`` is the instant where ``offset_min`` is known (a written zone, or a bare
    epoch number of at least nine digits) or else the wall clock counted as if in UTC, with ``offset_min``
    null. ``us`` is null where the text is no valid date or time. Fractions finer
    than a microsecond are cut off; a date alone means 00:00; a numeric date that
    does not start with the year has its day first, but its month first where
    ``lang`` is en-US; between points the day comes first in every language. A
    written zone name is that zone, ``named`` in the result, and the time is local
    to it. Each step is a projection of its own, so that an expression
    used several times is computed once and the generated code stays small.
    """
    keep = [c for c in rows.columns]
    step = rows.select(*keep, F.trim(F.lower(F.regexp_replace(F.col(raw), r"(?U)\s+", " "))).alias("_text"))
    text = F.col("_text")
    form = reduce(lambda rest, i: F.when(text.rlike(FORMS[i][0]), i).otherwise(rest), reversed(range(len(FORMS))), F.lit(None).cast("int"))
    step = step.select(*keep, "_text", form.alias("_form"))
    canon = reduce(lambda rest, i: F.when(F.col("_form") == i, F.regexp_replace(text, *FORMS[i])).otherwise(rest), range(len(FORMS)), F.lit(None).cast("string"))
    swap = (F.col(lang) == "en-US") if lang else F.lit(False)
    step = step.select(*keep, "_text", F.split(canon, r"\|").alias("_p"), F.coalesce((F.col("_form") == FLEXIBLE) & swap & ~text.rlike(r"^\d+\."), F.lit(False)).alias("_swap"))
    part = [F.element_at("_p", i) for i in range(1, 10)]
    step = step.select(*keep, "_text", "_swap", *(x.alias(f"_{n}") for n, x in zip(("y", "mo", "d", "h", "mi", "s", "f", "half", "zone"), part)))
    number = lambda c: F.col(c).try_cast("int")
    sign = r"^(?:utc|gmt)?([+-])(\d{1,2}):?(\d{2})?$"
    digits = F.length("_text")
    scale = F.when(digits.between(9, 11), 1_000_000).when(digits.between(12, 14), 1_000).when(digits.between(15, 17), 1)
    step = step.select(
        *keep,
        F.when(F.length("_y") == 2, number("_y") + F.when(number("_y") < 70, 2000).otherwise(1900)).otherwise(number("_y")).alias("_y"),
        F.when(F.col("_swap"), number("_d")).when(F.col("_mo").rlike("^[0-9]"), number("_mo")).otherwise(_lookup(F.col("_mo"), MONTHS)).alias("_mo"),
        F.when(F.col("_swap"), number("_mo")).otherwise(number("_d")).alias("_d"),
        F.when(F.col("_h") == "", 0).when(F.col("_half") == "", number("_h")).when(number("_h").between(1, 12), number("_h") % 12 + F.when(F.col("_half") == "p", 12).otherwise(0)).alias("_h"),
        F.when(F.col("_h") == "", 0).otherwise(number("_mi")).alias("_mi"),
        F.coalesce(number("_s"), F.lit(0)).alias("_s"),
        F.coalesce(F.rpad("_f", 6, "0").try_cast("int"), F.lit(0)).alias("_f"),
        F.col("_zone"),
        F.regexp_extract("_zone", sign, 1).alias("_sign"), F.regexp_extract("_zone", sign, 2).try_cast("int").alias("_zh"),
        F.coalesce(F.regexp_extract("_zone", sign, 3).try_cast("int"), F.lit(0)).alias("_zm"),
        F.when(F.col("_text").rlike("^[0-9]{9,17}$"), F.col("_text").try_cast("long") * scale).alias("_bare"),
    )
    step = step.select(
        *keep, "_bare", "_h", "_mi", "_s", "_f", "_zone", "_zm",
        F.try_to_date(F.format_string("%04d-%02d-%02d", "_y", "_mo", "_d"), "yyyy-MM-dd").alias("_date"),
        F.when(F.col("_zone").contains("/"), F.element_at(_zone_names(), F.col("_zone"))).alias("_named"),
        F.when(F.col("_sign") != "", (F.col("_zh") * 60 + F.col("_zm")) * F.when(F.col("_sign") == "-", -1).otherwise(1)).otherwise(_lookup(F.col("_zone"), ZONES)).alias("_offset"),
    )
    valid = F.col("_date").isNotNull() & F.col("_h").between(0, 23) & F.col("_mi").between(0, 59) & F.col("_s").between(0, 59) & ((F.col("_zone") == "") | (F.col("_offset").between(*OFFSETS) & (F.col("_zm") < 60)) | F.col("_named").isNotNull())
    wall = (F.unix_date("_date").cast("long") * 86400 + F.col("_h") * 3600 + F.col("_mi") * 60 + F.col("_s")) * 1_000_000 + F.col("_f")
    read = F.struct(
        F.coalesce("_bare", F.when(valid, wall - F.coalesce("_offset", F.lit(0)).cast("long") * 60_000_000)).alias("us"),
        F.when(F.col("_bare").isNotNull(), 0).when(valid, F.col("_offset")).cast("int").alias("offset_min"),
        F.when(valid, F.col("_named")).alias("named"),
    )
    # A one-row generator: filters on its result are not pushed below it, where they would repeat the whole parse.
    return step.select(*keep, F.explode(F.array(read)).alias("_t")).select(*keep, "_t.us", "_t.offset_min", "_t.named")


def known_zone(zone: Column) -> Column:
    """The zone name where the IANA database has it, else null."""
    return F.when(zone.isin(sorted(zoneinfo.available_timezones())), zone)


def local_to_instant(wall_us: Column, zone: Column) -> Column:
    """Instant of a wall clock in an IANA zone; the first of a time that occurs twice; null for a skipped one."""
    wall = F.timestamp_micros(wall_us)
    there = F.to_utc_timestamp(wall, zone)
    return F.when(F.from_utc_timestamp(there, zone) == wall, F.unix_micros(there))


def estimate_zones(rows: DataFrame, source: str, wall_us: str, seen_us: str, candidates: Sequence[str], after_us: str | None = None) -> DataFrame:
    """The zone of each source whose offset history violates what is known of its times least.

    ``rows`` has wall clocks without zone and, as far as known, the instants at
    which they were ingested (``seen_us``) and instants that came before them in
    the source's sequence (``after_us``, see ``sequence_bounds``). A candidate zone
    is violated by a row whose instant would lie outside these bounds or that the
    zone's clocks skip; the zone with the fewest violations wins, then the one with
    the least mean distance from the bounds, then the first by name. Rows are
    pre-aggregated by source and candidate; the candidates are a bounded list. Rows
    with a null wall clock or no bound do not vote. Returns (``source``,
    ``zone_estimate``).
    """
    at = F.explode(F.array(*(F.lit(z) for z in sorted(set(candidates))))).alias("zone")
    after = F.col(after_us) if after_us else F.lit(None).cast("long")
    bounded = rows.where(F.col(wall_us).isNotNull()).select(F.col(source).alias(source), F.col(wall_us).alias("w"), F.col(seen_us).alias("s"), after.alias("a"), at).where("s IS NOT NULL OR a IS NOT NULL")
    voted = bounded.withColumn("t", local_to_instant(F.col("w"), F.col("zone")))
    wrong = F.col("t").isNull() | F.coalesce(F.col("t") > F.col("s"), F.lit(False)) | F.coalesce(F.col("t") < F.col("a"), F.lit(False))
    lag = F.coalesce(F.abs(F.col("s") - F.col("t")), F.lit(0)) + F.coalesce(F.abs(F.col("t") - F.col("a")), F.lit(0))
    score = voted.groupBy(source, "zone").agg(F.count_if(wrong).alias("bad"), F.avg(lag).alias("lag"))
    return score.groupBy(source).agg(F.min(F.struct("bad", "lag", "zone"))["zone"].alias("zone_estimate"))


#: Places of a sequence that are looked at together.
SEQUENCE_RUN = 10_000


def sequence_bounds(rows: DataFrame, source: str, place: str, known_us: str) -> DataFrame:
    """Add ``after_us`` and ``before_us``: the nearest known instants before and behind each row in its source's sequence.

    The sequence is cut into runs of ``SEQUENCE_RUN`` places, so that a hot source
    is not one task; a run knows nothing of its neighbours, which only leaves the
    rows at its ends without a bound.
    """
    run = F.floor(F.col(place) / SEQUENCE_RUN)
    order = W.partitionBy(F.col(source), run).orderBy(F.col(place))
    before = F.last(known_us, ignorenulls=True).over(order.rowsBetween(W.unboundedPreceding, -1))
    behind = F.first(known_us, ignorenulls=True).over(order.rowsBetween(1, W.unboundedFollowing))
    return rows.select("*", before.alias("after_us"), behind.alias("before_us"))


def written_times(rows: DataFrame, record: str, fields: dict[str, bool], lang: str, zone: str, keep: Sequence[str] = ()) -> DataFrame:
    """Long form (``field``, ``record_id``, ``pos``, ``raw``, ``lang``, ``zone``) of the given text or list columns.

    ``fields`` tells of each column whether its times without zone are local (else UTC).
    """
    kinds = dict(rows.dtypes)
    parts = []
    for name, local in fields.items():
        z = known_zone(F.col(zone)) if local else F.lit("UTC")
        base = [F.lit(name).alias("field"), F.col(record).cast("long").alias("record_id")]
        rest = [F.col(lang).alias("lang"), z.alias("zone"), *(F.col(k).alias(f"k_{k}") for k in keep)]
        if kinds[name].startswith("array"):
            parts.append(rows.select(*base, F.posexplode(name).alias("pos", "raw"), *rest))
        else:
            parts.append(rows.where(F.col(name).isNotNull()).select(*base, F.lit(0).alias("pos"), F.col(name).alias("raw"), *rest))
    return reduce(DataFrame.unionByName, parts)


def parse_times(times: DataFrame) -> DataFrame:
    """Add ``us`` and ``offset_min`` of ``read_times`` to the long form; unreadable values drop out. A zone named with a time is its zone."""
    read = read_times(times, "raw", "lang").where("us IS NOT NULL")
    return read.withColumn("zone", F.coalesce("named", "zone")).drop("raw", "lang", "named")


def to_instants(parsed: DataFrame) -> DataFrame:
    """(``field``, ``record_id``, ``pos``, ``epoch_us``): one row of each value that denotes an instant.

    Repeated records give one row. Values in a zone that is not known are dropped.
    """
    zone = F.col("zone")
    instant = F.when(F.col("offset_min").isNotNull() | (zone == "UTC"), F.col("us")).when(zone.isNotNull(), local_to_instant(F.col("us"), zone))
    return parsed.select("field", "record_id", F.col("pos").cast("int").alias("pos"), instant.alias("epoch_us")).where("epoch_us IS NOT NULL").distinct()


def normalise_source_times(responses: DataFrame, candidates: DataFrame) -> DataFrame:
    """Instants of all written times of responses and candidates.

    A value's zone is the written one, else that of its row. Where the row's zone
    is missing or unknown it is estimated for the source from the alignment of its
    local times with the fetch times of the same responses (``estimate_zones``):
    among the zones that other rows state, or ``CANDIDATE_ZONES`` where none does.
    """
    resp = parse_times(written_times(responses, "response_id", {"last_modified": False, "response_date": False, "publication_dates": True}, "content_language", "time_zone"))
    cand = parse_times(written_times(candidates, "candidate_id", {"published_at": True}, "lang", "time_zone", ["response_id"]))
    stated = responses.select("time_zone").unionByName(candidates.select("time_zone")).select(known_zone(F.col("time_zone")).alias("zone")).distinct()
    zones = [r["zone"] for r in stated.collect()]  # bounded by the names of the IANA database
    placed = lambda d: d.where("offset_min IS NOT NULL OR zone IS NOT NULL").select("field", "record_id", "pos", "us", "offset_min", "zone")
    if None not in zones:  # every row states a known zone: nothing to estimate
        return to_instants(placed(resp).unionByName(placed(cand)))
    unplaced = lambda d: d.where("offset_min IS NULL AND zone IS NULL")
    seen = read_times(responses.select("response_id", "source_code", "response_date"), "response_date", None)
    fetch = seen.groupBy(F.col("response_id").alias("r")).agg(F.min("source_code").alias("source_code"), F.min("us").alias("seen"))
    asked = unplaced(resp).withColumn("r", F.col("record_id")).unionByName(unplaced(cand).withColumnRenamed("k_response_id", "r"))
    lost = asked.join(fetch, "r").select("field", "record_id", "pos", "us", "offset_min", "source_code", "seen")
    best = estimate_zones(lost, "source_code", "us", "seen", [z for z in zones if z] or CANDIDATE_ZONES)
    found = lost.join(best, "source_code").select("field", "record_id", "pos", "us", "offset_min", F.col("zone_estimate").alias("zone"))
    return to_instants(reduce(DataFrame.unionByName, [placed(resp), placed(cand), found]))


#: Zones tried where no row states any: one for each offset history of the publishers' regions.
CANDIDATE_ZONES = (
    "America/Argentina/Buenos_Aires", "America/Bogota", "America/La_Paz", "America/Lima", "America/Mexico_City", "America/New_York",
    "America/Santiago", "America/Sao_Paulo", "Asia/Shanghai", "Europe/London", "Europe/Madrid", "UTC",
)

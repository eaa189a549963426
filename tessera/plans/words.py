"""Queries of text functions, colours and appearances."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tessera.functions import wording as w
from tessera.functions.dialect import DUCK, SPARK
from tessera.sources.views import cte, rows

from .catalogue import query


def columns(name: str, view: str, /, where: str | None = None, doc: str = "", **exprs):
    """Register a query of expressions over a view; each is text, or a function of a dialect."""
    in_ = lambda d: [f"{e(d) if callable(e) else e} AS {a}" for a, e in exprs.items()]

    def run(spark, sf_dir):
        got = rows(spark, sf_dir, view)
        return (got.where(where) if where else got).selectExpr(*in_(SPARK))

    run.__name__, run.__doc__, run.__module__ = name, doc, __name__
    return query(f"WITH {cte(view)} SELECT {', '.join(in_(DUCK))} FROM {view}{f' WHERE {where}' if where else ''}")(run)


columns("x01_phrases", "acts", doc="Activities and verbs in words.", event_id="event_id", phrase=lambda d: w.phrase(d, "activity"), gerund=lambda d: w.gerund_phrase(d, "activity"), verb=lambda d: w.gerund(d, "verb"))
columns("x02_relations", "acts", doc="Relation and strength (tenths) of an activity and another.", event_id="event_id", relation=w.relation("activity", "other"), strength=lambda d: w.strength(d, "activity", "other"))
columns("x04_simplified", "acts", event_id="event_id", text=lambda d: w.simplified(d, "told"))
columns("x05_cleaned", "acts", event_id="event_id", text=lambda d: w.cleaned(d, "told"), articles=lambda d: d.sub("told", r"\ba ([aeiouAEIOU])", r"an \1"))
columns(
    "x07_doorways", "acts", doc="What the ontology calls a structure, in words.", event_id="event_id",
    text=lambda d: d.sub(d.sub("spoken", r"(?i)(enters|entering)( a)? scene through structure", r"\1 the camera~s view through a doorway/gate"), r"(exits|exiting|leaves|leaving)( a)? scene through structure", "leaving the camera~s view through a doorway/gate"),
)
columns("x08_anchors", "acts", event_id="event_id", anchor=w.anchor("(CAST((start_ms - start_ms % 1000) / 1000 AS BIGINT) % 300)"))
columns("x09_appearance", "acts", event_id="event_id", appearance=lambda d: w.has_appearance(d, "told"), visual=lambda d: w.is_visual(d, "told"), visual_camera=lambda d: w.is_visual(d, "told", w.VISUAL_CAMERA))
columns("f06_entity_types", "acts", doc="Entrances, person and vehicle activities.", event_id="event_id", kind="CASE WHEN activity LIKE 'vehicle_%' THEN 'vehicle' ELSE 'person' END", entrance="activity IN ('person_enters_scene_through_structure', 'person_exits_vehicle')")
columns("x10_colours", "people", id="id", plain=lambda d: w.case("upper", w.PLAIN, "upper"), alike=lambda d: w.similar_colours(w.normal_colour(d, "upper"), w.normal_colour(d, "lower")))
columns("x11_colour_scores", "people", id="id", score=lambda d: w.colour_score(d, "upper", "lower", "seen"))
columns("x12_hsv_names", "people", id="id", colour=w.hsv_colour("h", "s", "v"), brightness="CASE WHEN s >= 40 AND v >= 60 AND v < 90 THEN 'dark' WHEN s >= 40 AND v > 190 THEN 'light' ELSE '' END")
columns("x14_descriptions", "people", id="id", text=lambda d: w.described(d))
columns("x15_heights", "people", id="id", height="CASE WHEN height >= 200 THEN 'tall' WHEN height <= 80 THEN 'short' ELSE '' END", lower_garment="CASE WHEN dress >= greatest(skirt, pants, 50) THEN 'dress' WHEN skirt >= greatest(pants, 50) THEN 'skirt' WHEN pants >= 50 THEN 'pants' ELSE 'unknown' END")
columns(
    "x16_names", "acts", doc="Parts of clip names, slots without seconds, camera names, safe file names and cut texts.", event_id="event_id",
    site=lambda d: d.extract("clip", r"^[^.]+\.[^.]+\.[^.]+\.([^.]+)\."), clip_camera=lambda d: d.extract("clip", r"\.(G[0-9]+)\."), short_slot=lambda d: d.sub(d.extract("clip", r"^([^.]+\.[0-9]+-[0-9]+-[0-9]+)\."), r"-[0-9]+$", ""),
    view=lambda d: "'camera ' || CAST(CAST(" + d.extract("'cam0' || CAST(actor % 9 AS STRING)", "([0-9]+)$") + " AS BIGINT) AS STRING)", safe=lambda d: d.sub("clip || '/ä'", r"[^A-Za-z0-9_.\-]", "_"), cut="CASE WHEN length(told) > 30 THEN substr(told, 1, 30) || '...' ELSE told END", mp4="replace(clip, '.avi', '.mp4')",
)
columns("x22_answers", "acts", doc="Fields of a model's fenced JSON and of its lines; what a question costs in tokens.", event_id="event_id", k=lambda d: (f"get_json_object({d.extract('reply', '([{][^}]*[}])')}, '$.k')" if d.spark else f"json_extract_string({d.extract('reply', '([{][^}]*[}])')}, '$.k')"), activity=lambda d: "trim(" + d.extract("lines", r"ACTIVITY:\s*([^\n]*)") + ")", description=lambda d: "trim(" + d.extract("lines", r"DESCRIPTION:\s*([^\n]*)") + ")", tokens="450 * (1 + event_id % 14)")


def _centi(ms: str) -> str:
    """Milliseconds as seconds with two places."""
    c = f"CAST(({ms} + 5 - ({ms} + 5) % 10) / 10 AS BIGINT)"
    return f"CAST(CAST(({c} - {c} % 100) / 100 AS BIGINT) AS STRING) || '.' || lpad(CAST({c} % 100 AS STRING), 2, '0')"


columns("h09_debug", "acts", doc="Clip, frames and seconds of each event as they are shown.", event_id="event_id", clip="replace(clip, '.avi', '.mp4')", frames="CAST(CAST((start_ms * 30 - (start_ms * 30) % 1000) / 1000 AS BIGINT) AS STRING) || '-' || CAST(CAST((end_ms * 30 - (end_ms * 30) % 1000) / 1000 AS BIGINT) AS STRING)", seconds=f"{_centi('start_ms')} || '-' || {_centi('end_ms')} || 's'", start_sec_centi="CAST(floor((start_ms + 5) / 10.0) AS BIGINT)")

PEOPLE = cte("people")


def people(spark, sf_dir):
    return rows(spark, sf_dir, "people")


_VOTE = "(SELECT cluster, arg_min(v, (-n, f)) AS winner FROM (SELECT cluster, v, count(*) AS n, min(id) AS f FROM (SELECT cluster, id, {c} AS v FROM people) WHERE v <> 'unknown' AND v <> '' GROUP BY ALL) GROUP BY cluster)"
_MERGED = ["hair", "upper", "lower", "lower_type", "shoe", "upper_brightness", "lower_brightness", "upper_texture", "lower_texture"]


@query(
    f"WITH {PEOPLE}, acc AS (SELECT cluster, array_to_string(list_sort(list_distinct(flatten(list(string_split(accessories, ','))))), ',') AS accessories FROM people WHERE accessories <> '' GROUP BY cluster), c AS (SELECT DISTINCT cluster FROM people), m AS (SELECT c.cluster, "
    + ", ".join(f"coalesce(t_{c}.winner, 'unknown') AS {c}" for c in _MERGED)
    + ", coalesce(accessories, '') AS accessories FROM c "
    + " ".join(f"LEFT JOIN {_VOTE.format(c=c)} t_{c} ON t_{c}.cluster = c.cluster" for c in _MERGED)
    + f" LEFT JOIN acc ON acc.cluster = c.cluster) SELECT cluster, {w.described(DUCK)} AS text FROM m"
)
def h01_merged_descriptions(spark, sf_dir):
    """One description for the sightings of a person: the commonest value of each attribute (of equals the first seen), all accessories.

    Votes are counted before they are shuffled: one row for each cluster, attribute and value."""
    p = people(spark, sf_dir)
    long = p.select("cluster", "id", F.inline(F.array(*[F.struct(F.lit(c).alias("a"), F.col(c).alias("v")) for c in _MERGED]))).where("v <> 'unknown' and v <> ''")
    n = long.groupBy("cluster", "a", "v").agg(F.count("*").alias("n"), F.min("id").alias("f"))
    won = n.groupBy("cluster", "a").agg(F.min_by("v", F.struct(-F.col("n"), "f")).alias("v"))
    wide = won.groupBy("cluster").pivot("a", _MERGED).agg(F.first("v"))
    acc = p.where("accessories <> ''").select("cluster", F.explode(F.split("accessories", ",")).alias("x")).distinct().groupBy("cluster").agg(F.array_join(F.array_sort(F.collect_list("x")), ",").alias("accessories"))
    all_ = p.select("cluster").distinct().join(wide, "cluster", "left").join(acc, "cluster", "left").na.fill("unknown", _MERGED).na.fill("", ["accessories"])
    return all_.selectExpr("cluster", f"{w.described(SPARK)} AS text")


@query(f"WITH {PEOPLE}, x AS (SELECT cluster, unnest(string_split(accessories, ',')) AS item, count(*) OVER (PARTITION BY cluster) AS m FROM people), n AS (SELECT cluster, item, count(*) AS n, (SELECT count(*) FROM people p WHERE p.cluster = x.cluster) AS crops FROM x WHERE item <> '' GROUP BY cluster, item) SELECT cluster, item, n FROM n WHERE n >= 2 OR crops <= 2")
def a10_seen_items(spark, sf_dir):
    """Accessories seen in two crops of a person or more, or in any if there are two crops at most."""
    p = people(spark, sf_dir)
    crops = p.groupBy("cluster").agg(F.count("*").alias("crops"))
    n = p.select("cluster", F.explode(F.split("accessories", ",")).alias("item")).where("item <> ''").groupBy("cluster", "item").agg(F.count("*").alias("n"))
    return n.join(crops, "cluster").where("n >= 2 or crops <= 2").select("cluster", "item", "n")


@query(f"WITH {PEOPLE} SELECT camera, upper, count(*) AS n, count(*) FILTER (height >= 200) AS n_tall FROM people WHERE upper <> 'unknown' GROUP BY ALL")
def a21_colour_distribution(spark, sf_dir):
    return people(spark, sf_dir).where("upper <> 'unknown'").groupBy("camera", "upper").agg(F.count("*").alias("n"), F.count_if(F.expr("height >= 200")).alias("n_tall"))


@query(f"""WITH {PEOPLE}, g AS (SELECT id, camera, upper, height, count(*) OVER w AS n, row_number() OVER (PARTITION BY camera, upper ORDER BY height, id) AS r, max(height) OVER w - min(height) OVER w AS spread FROM people WINDOW w AS (PARTITION BY camera, upper)),
 m AS (SELECT camera, upper, height AS median FROM g WHERE r = n // 2 + 1) SELECT id, CASE WHEN n < 2 OR spread * 10 < median * 3 THEN '' WHEN height * 10 > median * 12 THEN 'tall' WHEN height * 10 < median * 8 THEN 'short' ELSE '' END AS label FROM g JOIN m ON m.camera = g.camera AND m.upper = g.upper""")
def w09_heights(spark, sf_dir):
    """People of one description on a camera as tall or short among them, where their heights differ by 30 % of the upper median."""
    k = Window.partitionBy("camera", "upper")
    p = people(spark, sf_dir).select("id", "camera", "upper", "height")
    g = p.withColumns({"n": F.count("*").over(k), "r": F.row_number().over(k.orderBy("height", "id")), "spread": F.max("height").over(k) - F.min("height").over(k)})
    median = F.max(F.when(F.col("r") == F.floor(F.col("n") / 2) + 1, F.col("height"))).over(k)
    return g.withColumn("median", median).select("id", F.expr("case when n < 2 or spread * 10 < median * 3 then '' when height * 10 > median * 12 then 'tall' when height * 10 < median * 8 then 'short' else '' end").alias("label"))


_H3 = "CASE WHEN gpt <> '' THEN 'a person ' || gpt WHEN seen <> 'a person' THEN seen WHEN length(vlm) > 10 THEN vlm WHEN upper <> 'unknown' OR lower <> 'unknown' THEN 'a person in ' || CASE WHEN upper <> 'unknown' THEN upper || ' top' ELSE '' END || CASE WHEN upper <> 'unknown' AND lower <> 'unknown' THEN ' and ' ELSE '' END || CASE WHEN lower <> 'unknown' THEN lower || ' pants' ELSE '' END ELSE 'a person walks' END"
_H3_SOURCE = "CASE WHEN gpt <> '' THEN 'gpt' WHEN seen <> 'a person' THEN 'geom' WHEN length(vlm) > 10 THEN 'vlm' WHEN upper <> 'unknown' OR lower <> 'unknown' THEN 'colours' ELSE 'activity' END"
columns("h03_description_cascade", "people", doc="The best description of each person, by source.", id="id", text=_H3, source=_H3_SOURCE)


@query()
def g07_person_assignment(spark, sf_dir):
    """Known persons (every fifth) given to the others of a camera: each takes the unused one whose colours fit best, if they do not
    contradict.  A camera's people are one group of a slot."""
    import pandas as pd

    p = people(spark, sf_dir).withColumn("slot", F.expr("id div 200"))
    known = p.where("id % 5 = 0").selectExpr("slot", "camera", "id AS known", "upper AS k_upper", "lower AS k_lower")
    pairs = p.where("id % 5 <> 0").join(known, ["slot", "camera"]).selectExpr("slot", "camera", "id", "known", f"{w.colour_score(SPARK, 'k_upper', 'k_lower', 'seen')} AS score")

    def assign(frame: pd.DataFrame) -> pd.DataFrame:
        used, out = set(), []
        for _, of in frame.sort_values(["id", "known"]).groupby("id", sort=True):
            free = of[~of["known"].isin(used)]
            if len(free):
                best = free.loc[free["score"].idxmax()]
                if best["score"] >= -0.5:
                    used.add(best["known"])
                    out.append(best)
        return pd.DataFrame(out, columns=frame.columns)

    return pairs.groupBy("slot", "camera").applyInPandas(assign, pairs.schema)

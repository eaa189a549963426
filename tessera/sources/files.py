"""Readers of the reference's file formats as functions of DataFrames of (path, value) texts, and of file listings.

`annotations.whole_texts` makes such a DataFrame of files; a file is one row."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def first_by_priority(df: DataFrame, keys: list[str], priority: Column, *ties: str) -> DataFrame:
    """Of rows with equal keys the one of least priority, then of least ties."""
    rest = [c for c in df.columns if c not in keys]
    order = F.struct(priority.alias("__p"), *[F.col(t) for t in ties])
    return df.groupBy(*keys).agg(F.min_by(F.struct(*rest), order).alias("r")).select(*keys, *[f"r.{c}" for c in rest])


def merged_right(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of both; of equal keys the right one."""
    both = left.withColumn("__side", F.lit(1)).unionByName(right.withColumn("__side", F.lit(0)))
    return first_by_priority(both, keys, F.col("__side")).drop("__side")


def _yaml(parse, schema: str, columns: list[str]):
    """A mapper over (path, value) texts that calls parse(entry) for each list entry of each YAML text."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import yaml

        loader = getattr(yaml, "CSafeLoader", yaml.SafeLoader)
        for frame in batches:
            rows = [(path, *row) for path, text in zip(frame["path"], frame["value"]) for entry in yaml.load(text or "", loader) or [] if (row := parse(entry))]
            yield pd.DataFrame(rows, columns=columns)

    return run


def parse_activities(texts: DataFrame) -> DataFrame:
    """path, activity, act_id, start_frame, end_frame, actor_ids of activity entries; those without a span of two frames are left out,
    and a missing activity is "unknown"."""

    def one(entry: dict):
        act = entry.get("act") or {}
        span = ((act.get("timespan") or [{}])[0] or {}).get("tsr0") or []
        if len(span) < 2:
            return None
        return next(iter(act.get("act2") or {}), "unknown"), act.get("id2"), span[0], span[1], [a["id1"] for a in act.get("actors") or [] if "id1" in a]

    columns = ["path", "activity", "act_id", "start_frame", "end_frame", "actor_ids"]
    return texts.select("path", "value").mapInPandas(_yaml(one, "", columns), "path string, activity string, act_id long, start_frame long, end_frame long, actor_ids array<long>")


def parse_types(texts: DataFrame) -> DataFrame:
    """path, actor_id, kind (the first key of cset3) of type entries."""

    def one(entry: dict):
        t = entry.get("types") or {}
        return (t["id1"], next(iter(t.get("cset3") or {}), "unknown")) if "id1" in t else None

    return texts.select("path", "value").mapInPandas(_yaml(one, "", ["path", "actor_id", "kind"]), "path string, actor_id long, kind string")


def parse_box_texts(texts: DataFrame) -> DataFrame:
    """path, actor_id, frame, x1, y1, x2, y2 of whole box files in any layout: entries inline or with a field on each line, in any order.

    An entry begins at a dash or at its first repeated field; here entries are cut before each "- " at a line's start, and where there
    is none before each id1.  Signs are kept; decimals are cut to whole pixels."""
    entry = F.explode(F.filter(F.split("value", r"(?m)(?=^\s*-\s)|(?<=\n)(?=\s*'?id1'?\s*:)"), lambda x: x.contains("g0")))
    e = texts.select("path", entry.alias("e"))
    number = lambda name: F.expr(rf"try_cast(regexp_extract(e, r'{name}\W+?(-?[0-9]+)', 1) as long)")
    side = r"\s+".join([r"(-?[0-9]+)(?:\.[0-9]+)?"] * 4)
    box = lambda i: F.expr(rf"try_cast(regexp_extract(e, r'g0[^0-9-]+{side}', {i}) as long)")
    got = e.select("path", number("id1").alias("actor_id"), number("ts0").alias("frame"), *[box(i).alias(n) for i, n in enumerate(("x1", "y1", "x2", "y2"), 1)])
    return got.where("x2 is not null and frame is not null")


def parse_cameras(texts: DataFrame) -> DataFrame:
    """path, k, r (9 doubles by rows), t (3), d (lens distortion; null if there is no such line) of camera matrix files."""
    lines = F.filter(F.split("value", "\n"), lambda x: F.trim(x) != "")
    n = F.transform(lines, lambda x: F.split(F.trim(x), "[ \t]+").cast("array<double>"))
    got = texts.select("path", n.alias("n"))
    return got.select("path", F.flatten(F.slice("n", 1, 3)).alias("k"), F.flatten(F.slice("n", 4, 3)).alias("r"), F.get("n", F.lit(6)).alias("t"), F.get("n", F.lit(7)).alias("d"))


def sighting_names(lines: DataFrame, value: str = "value") -> DataFrame:
    """person and camera of image names PPPPOoooCcccTttttFfffff.jpg, each two once; other lines are left out."""
    parts = r"^([0-9]{4})O[0-9]{3}C([0-9]{3})T[0-9]{3,4}F[0-9]{5}\.jpg$"
    got = lines.select(F.regexp_extract(value, parts, 1).alias("person"), F.concat(F.lit("G"), F.regexp_extract(value, parts, 2)).alias("camera"))
    return got.where("person <> ''").distinct()


def clip_names(lines: DataFrame, value: str = "value") -> DataFrame:
    """The columns of lines, and date, start, end, site, camera of clip names or addresses date.start.end.site.camera(.r13).avi or .mp4;
    other lines are left out."""
    parts = r"([0-9]{4}-[0-9]{2}-[0-9]{2})\.([0-9]{2}-[0-9]{2}-[0-9]{2})\.([0-9]{2}-[0-9]{2}-[0-9]{2})\.([a-z]+)\.(G[0-9]+)\."
    return lines.select("*", *[F.regexp_extract(value, parts, i).alias(n) for i, n in enumerate(("date", "start", "end", "site", "camera"), 1)]).where("camera <> ''")


def parse_persons(texts: DataFrame) -> DataFrame:
    """person, gpt, upper, lower, cameras (sorted) of person databases: {"persons": {id: {...}}}."""
    schema = "struct<persons: map<string, struct<gpt_description: string, primary_upper_color: string, primary_lower_color: string, cameras: map<string, string>>>>"
    p = texts.select(F.explode(F.from_json("value", schema)["persons"]).alias("person", "p"))
    return p.select("person", F.col("p.gpt_description").alias("gpt"), F.coalesce("p.primary_upper_color", F.lit("unknown")).alias("upper"), F.coalesce("p.primary_lower_color", F.lit("unknown")).alias("lower"), F.array_sort(F.map_keys("p.cameras")).alias("cameras"))


def parse_descriptions(texts: DataFrame, model: bool = False) -> DataFrame:
    """entity, description of description files; generic ones are left out, and of a model's also those of ten characters or fewer."""
    if model:
        d = texts.select(F.explode(F.from_json("value", "struct<descriptions: map<string, string>>")["descriptions"]).alias("entity", "description"))
        return d.where("length(description) > 10 and lower(description) <> 'a person'")
    d = texts.select(F.explode(F.from_json("value", "struct<actors: map<string, struct<description: string>>>")["actors"]).alias("entity", "a")).select("entity", F.col("a.description").alias("description"))
    return d.where("description is not null and description not in ('', 'a person')")


#: Objects and relations of a frame in a scene graph.
GRAPH = (
    "struct<scene_token: string, frames: array<struct<frame_idx: long, objects: array<struct<object_id: string, annotation_token: string, object_class: string, position: array<double>, velocity: array<double>, visibility: int>>,"
    " relationships: array<struct<source_id: string, target_id: string, relationship_type: string, distance: double>>>>>"
)


def parse_scene_graphs(texts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(objects, relations) of scene graph documents; an object without an id goes by its annotation token."""
    f = texts.select(F.from_json("value", GRAPH).alias("g")).select("g.scene_token", F.explode("g.frames").alias("f"))
    o = f.select("scene_token", "f.frame_idx", F.explode("f.objects").alias("o"))
    objects = o.select("scene_token", "frame_idx", F.coalesce("o.object_id", "o.annotation_token").alias("object_id"), F.coalesce("o.object_class", F.lit("unknown")).alias("object_class"), "o.position", "o.velocity", "o.visibility")
    r = f.select("scene_token", "f.frame_idx", F.explode("f.relationships").alias("r"))
    return objects, r.select("scene_token", "frame_idx", "r.*")


def parse_points(files: DataFrame) -> DataFrame:
    """path, n, points (x, y, z, intensity, ring of each, end to end) of binary point clouds of four floats a point; the ring is 0."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import numpy as np

        for frame in batches:
            clouds = [np.frombuffer(c, "<f4").reshape(-1, 4) for c in frame["content"]]
            flat = [np.hstack([c, np.zeros((len(c), 1), "f4")]).ravel().tolist() for c in clouds]
            yield pd.DataFrame({"path": frame["path"], "n": [len(c) for c in clouds], "points": flat})

    return files.select("path", "content").mapInPandas(run, "path string, n long, points array<float>")


def list_places(nodes: DataFrame) -> DataFrame:
    """token, head, place of the nodes (token, next) of linked lists, found by jumps of doubled length; a cycle raises."""
    prev = nodes.select(F.col("next").alias("token"), F.col("token").alias("prev")).where("token is not null")
    state = nodes.select("token").join(prev, "token", "left").select("token", F.coalesce("prev", "token").alias("up"), F.when(F.col("prev").isNull(), 0).otherwise(1).cast("long").alias("place"))
    for _ in range(64):
        state = state.checkpoint()
        above = state.select(F.col("token").alias("up"), F.col("up").alias("top"), F.col("place").alias("more"))
        new = state.join(above, "up").select("token", F.col("top").alias("up"), (F.col("place") + F.col("more")).alias("place"), (F.col("more") > 0).alias("moved"))
        new = new.checkpoint()
        if not new.where("moved").take(1):
            return new.select("token", F.col("up").alias("head"), "place")
        state = new.drop("moved")
    raise ValueError("a linked list has a cycle")


def video_paths(clips: Column, folder: Column) -> Column:
    """The paths of clips in a folder, with one ending whatever theirs was, each once and sorted."""
    stem = lambda c: F.regexp_replace(F.regexp_replace(c, r"\.(mp4|avi)$", ""), r"\.r13$", "")
    some = F.filter(clips, lambda c: c.isNotNull() & (c != ""))
    return F.array_sort(F.array_distinct(F.transform(some, lambda c: F.concat(folder, F.lit("/"), stem(c), F.lit(".r13.mp4")))))


def filled(template: str, **values: Column) -> Column:
    """A prompt template with its {names} replaced."""
    out = F.lit(template)
    for name, value in values.items():
        out = F.replace(out, F.lit("{" + name + "}"), value.cast("string"))
    return out

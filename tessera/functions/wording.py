"""Text functions over activities, descriptions and names, as expressions in a dialect (column texts in, expression out)."""

from __future__ import annotations

from .dialect import Dialect

# Phrases of activities that are more than their words, and their -ing forms.
PHRASES = {
    "person_enters_scene_through_structure": ("enters the camera's view through a doorway", "Entering the camera's view through a doorway"),
    "person_exits_scene_through_structure": ("leaves the camera's view through a doorway", "Leaving the camera's view through a doorway"),
    "hand_interacts_with_person": ("physically interacts with another person", "Physically interacting with another person"),
    "person_interacts_with_laptop": ("uses a laptop", "Using a laptop"),
    "person_transfers_object": ("hands an object to someone", "Handing an object to someone"),
    "person_carries_heavy_object": ("carries a heavy object", "Carrying a heavy object"),
    "person_abandons_package": ("leaves a package behind", "Leaving a package behind"),
    "person_steals_object": ("takes an object", "Taking an object"),
    "vehicle_starts": ("starts moving", "Starting to move"),
    "vehicle_stops": ("comes to a stop", "Coming to a stop"),
    "vehicle_reverses": ("reverses", "Reversing"),
    "vehicle_turns_left": ("turns left", "Turning left"),
    "vehicle_turns_right": ("turns right", "Turning right"),
    "vehicle_makes_u_turn": ("makes a U-turn", "Making a U-turn"),
    "vehicle_drops_off_person": ("drops off a person", "Dropping off a person"),
    "vehicle_picks_up_person": ("picks up a person", "Picking up a person"),
}
# Fixed values: -ing forms of verbs.
GERUNDS = {
    "opens": "opening", "closes": "closing", "enters": "entering", "exits": "exiting", "reads": "reading", "carries": "carrying", "picks": "picking", "puts": "putting", "sets": "setting", "rides": "riding",
    "loads": "loading", "unloads": "unloading", "talks": "talking", "stands": "standing", "walks": "walking", "runs": "running", "sits": "sitting", "texts": "texting", "pulls": "pulling", "pushes": "pushing",
    "interacts": "interacting", "drops": "dropping", "embraces": "embracing", "uses": "using", "makes": "making", "steals": "stealing", "starts": "starting", "stops": "stopping", "turns": "turning",
    "transfers": "transferring", "reverses": "reversing", "abandons": "abandoning", "leaves": "leaving", "purchases": "purchasing",
}
# Words after a verb that take no article.
NO_ARTICLE = "up down on off out in to from through with around right left a an the into onto over away".split()
# Which activities lead to which, and which go together.
CAUSES = {
    "person_picks_up_object": "person_carries_heavy_object person_puts_down_object person_transfers_object",
    "person_puts_down_object": "person_abandons_package",
    "person_opens_trunk": "person_loads_vehicle person_unloads_vehicle person_closes_trunk",
    "person_loads_vehicle": "person_closes_trunk",
    "person_unloads_vehicle": "person_closes_trunk person_carries_heavy_object",
    "person_opens_vehicle_door": "person_enters_vehicle person_exits_vehicle person_closes_vehicle_door",
    "person_enters_vehicle": "person_closes_vehicle_door vehicle_starts",
    "person_exits_vehicle": "person_closes_vehicle_door",
    "person_opens_facility_door": "person_enters_scene_through_structure person_exits_scene_through_structure person_closes_facility_door",
    "person_enters_scene_through_structure": "person_closes_facility_door",
    "person_exits_scene_through_structure": "person_closes_facility_door",
    "vehicle_stops": "person_exits_vehicle vehicle_starts",
    "vehicle_starts": "vehicle_turns_left vehicle_turns_right vehicle_makes_u_turn",
    "person_sits_down": "person_stands_up",
    "vehicle_drops_off_person": "person_enters_scene_through_structure",
    "vehicle_picks_up_person": "vehicle_starts",
}
TOGETHER = [
    ("person_talks_to_person", "person_embraces_person"), ("person_talks_on_phone", "person_texts_on_phone"), ("person_reads_document", "person_interacts_with_laptop"), ("person_enters_vehicle", "person_exits_vehicle"),
    ("person_opens_vehicle_door", "person_closes_vehicle_door"), ("person_opens_trunk", "person_closes_trunk"), ("person_opens_facility_door", "person_closes_facility_door"),
    ("person_picks_up_object", "person_puts_down_object"), ("person_loads_vehicle", "person_unloads_vehicle"), ("vehicle_starts", "vehicle_stops"),
]
# Words of visual descriptions (the shorter list is that of camera questions), and words of appearance.
VISUAL = "top|pants|wearing|shirt|jacket|hoodie|shorts|color|blue|red|black|white|green|gray|grey|yellow|brown|orange|purple|pink|navy|dark|light|backpack|bag|suitcase|hat|cap|dress|coat"
VISUAL_CAMERA = "top|pants|wearing|shirt|jacket|color|blue|red|black|white|green|gray|yellow|brown|orange|purple|backpack|bag"
APPEARANCE = "wearing shirt top pants jacket hoodie backpack blue red green gray grey black white dark light brown orange yellow purple pink navy beige tan khaki camouflage striped patterned logo graphic garment clothing jeans shorts dress skirt hat cap glasses sunglasses scarf vest coat boots sneakers bottle bag purse suitcase umbrella".split()
# Groups of similar colours, and plain names of fine ones.
SIMILAR = [
    "black charcoal dark", "charcoal dark", "gray grey silver", "white ivory light", "red crimson maroon rust", "orange rust", "yellow gold khaki", "green olive teal", "blue navy indigo teal", "purple plum indigo mauve",
    "pink mauve", "brown khaki beige", "beige khaki ivory", "navy blue indigo", "olive green khaki",
]
PLAIN = {"navy": "dark blue", "indigo": "dark blue", "charcoal": "dark gray", "rust": "brown", "plum": "purple", "mauve": "pink", "gold": "yellow", "khaki": "tan", "ivory": "white", "beige": "tan", "crimson": "red", "maroon": "dark red", "silver": "gray"}
# Garments in plain words, in this order, and postures that are left out.
GARMENTS = [("upper body garment with a hood", "hoodie"), ("upper body garment", "top"), ("lower body clothing", "pants"), ("lower body garment", "pants"), ("lower body pants", "pants"), ("lower body shorts", "shorts"), ("hooded jacket", "hoodie")]
POSTURES = [r",?\s*sitting on a chair[^,\.]*", r",?\s*with their back turned[^,\.]*", r",?\s*while ascending a staircase[^,\.]*", r",?\s*while holding a clipboard or some papers", r",?\s*and they appear to have\s+", r",?\s*sitting\b[^,\.]*"]


def quoted(v: str) -> str:
    """A literal; chr(39) stands for a quote, as engines escape it in different ways."""
    return "(" + " || chr(39) || ".join(f"'{p}'" for p in v.split("'")) + ")" if "'" in v else f"'{v}'"


def case(column: str, table: dict[str, str], other: str) -> str:
    return f"CASE {column} " + " ".join(f"WHEN {quoted(k)} THEN {quoted(v)}" for k, v in table.items()) + f" ELSE {other} END"


def phrase(d: Dialect, activity: str) -> str:
    """person_opens_trunk: opens trunk"""
    plain = f"replace({d.sub(activity, '^(person|vehicle|hand)_', '')}, '_', ' ')"
    return case(activity, {k: v[0] for k, v in PHRASES.items()}, plain)


def gerund(d: Dialect, verb: str) -> str:
    """The -ing form of a verb in the third person."""
    base = f"CASE WHEN {verb} LIKE '%es' THEN substr({verb}, 1, length({verb}) - 2) WHEN {verb} LIKE '%s' AND {verb} NOT LIKE '%ss' THEN substr({verb}, 1, length({verb}) - 1) ELSE {verb} END"
    doubled = d.match(f"({base})", "[^aeiou][aeiou][^aeiouwxy]$")
    rule = (
        f"CASE WHEN ({base}) LIKE '%ie' THEN substr({base}, 1, length({base}) - 2) || 'ying' WHEN ({base}) LIKE '%ee' THEN ({base}) || 'ing' WHEN ({base}) LIKE '%e' THEN substr({base}, 1, length({base}) - 1) || 'ing'"
        f" WHEN {doubled} THEN ({base}) || substr({base}, length({base}), 1) || 'ing' ELSE ({base}) || 'ing' END"
    )
    return case(verb, GERUNDS, rule)


def gerund_phrase(d: Dialect, activity: str) -> str:
    """person_opens_trunk: Opening a trunk"""
    words = f"replace({d.sub(activity, '^(person|vehicle|hand)_', '')}, '_', ' ')"
    verb, rest = d.extract(words, "^([^ ]*)"), d.extract(words, "^[^ ]* (.*)$")
    first = d.extract(rest, "^([^ ]*)")
    listed = ", ".join(quoted(w) for w in NO_ARTICLE)
    full = f"CASE WHEN {rest} = '' THEN '' WHEN {first} IN ({listed}) THEN ' ' || {rest} WHEN {d.match(first, '^[aeiou]')} THEN ' an ' || {rest} ELSE ' a ' || {rest} END"
    made = f"({gerund(d, verb)}) || {full}"
    return case(activity, {k: v[1] for k, v in PHRASES.items()}, f"upper(substr({made}, 1, 1)) || lower(substr({made}, 2))")


def relation(a: str, b: str) -> str:
    """causal, reverse_causal, co_occurring or null."""
    either = lambda x, y: " OR ".join(f"({x} = '{k}' AND {y} IN ({', '.join(quoted(v) for v in vs.split())}))" for k, vs in CAUSES.items())
    both = " OR ".join(f"({a} = '{x}' AND {b} = '{y}') OR ({a} = '{y}' AND {b} = '{x}')" for x, y in TOGETHER)
    return f"CASE WHEN {either(a, b)} THEN 'causal' WHEN {either(b, a)} THEN 'reverse_causal' WHEN {both} THEN 'co_occurring' END"


def related() -> set[tuple[str, str]]:
    """The activities that have a relation, both ways."""
    one = {(k, v) for k, vs in CAUSES.items() for v in vs.split()} | set(TOGETHER)
    return one | {(b, a) for a, b in one}


def relation_bits(activity: str, prefix: str = "") -> dict[str, str]:
    """Columns of an activity as bits: itself, those it causes, those that occur with it.  relation_of tells the relation of two rows by
    them, at a fraction of the cost of relation on each pair."""
    names = sorted({a for p in related() for a in p})
    bits = lambda others: sum(1 << names.index(o) for o in others)
    both = {a: [y if x == a else x for x, y in TOGETHER if a in (x, y)] for a in names}
    column = lambda table: f"CASE {activity} " + " ".join(f"WHEN {quoted(a)} THEN {n}L" for a, n in table.items() if n) + " ELSE 0L END"
    return {f"{prefix}is": column({a: bits([a]) for a in names}), f"{prefix}causes": column({a: bits(vs.split()) for a, vs in CAUSES.items()}), f"{prefix}together": column({a: bits(o) for a, o in both.items()})}


def relation_of(a: str, b: str) -> str:
    """relation of two rows whose columns of relation_bits have these prefixes."""
    return f"CASE WHEN {a}causes & {b}is <> 0 THEN 'causal' WHEN {b}causes & {a}is <> 0 THEN 'reverse_causal' WHEN {a}together & {b}is <> 0 THEN 'co_occurring' END"


def strength(d: Dialect, a: str, b: str) -> str:
    """Strength of a relation in tenths."""
    r = relation(a, b)
    return f"CASE {r} WHEN 'causal' THEN 10 WHEN 'reverse_causal' THEN 9 WHEN 'co_occurring' THEN 7 ELSE CASE WHEN {d.extract(a, '^([^_]*)')} = {d.extract(b, '^([^_]*)')} THEN 3 ELSE 0 END END"


def simplified(d: Dialect, text: str) -> str:
    """A description in plain garments, without postures."""
    out = d.sub(text, r"[. ]+$", "")
    for a, b in GARMENTS:
        out = d.sub(out, f"(?i){a}", b)
    for p in POSTURES:
        out = d.sub(out, f"(?i){p}", "")
    out = d.sub(d.sub(out, r",\s*,", ","), r"\s{2,}", " ")
    return d.sub(d.sub(out, "^[, ]+|[, ]+$", ""), r"\.+$", "")


def cleaned(d: Dialect, text: str) -> str:
    """Without "unknown", and "an" before vowels."""
    return d.sub(d.sub(text, r"(?i)\bunknown\s+", ""), r"(?i)\ba\s+([aeiou])", r"an \1")


def is_visual(d: Dialect, text: str, words: str = VISUAL) -> str:
    return f"(lower({text}) NOT IN ('a person', 'a vehicle', 'someone') AND {d.match(f'lower({text})', words)})"


def has_appearance(d: Dialect, text: str) -> str:
    """Whether two different words or more are of appearance."""
    return f"({d.shared(f'lower({text})', quoted(' '.join(APPEARANCE)))} >= 2)"


def similar_colours(a: str, b: str) -> str:
    groups = " OR ".join(f"({a} IN ({g}) AND {b} IN ({g}))" for g in (", ".join(quoted(c) for c in s.split()) for s in SIMILAR))
    return f"({a} <> '' AND {b} <> '' AND ({a} = {b} OR {groups}))"


def normal_colour(d: Dialect, colour: str) -> str:
    return d.sub(f"lower(trim({colour}))", "^(dark|light|bright) ", "")


def colour_score(d: Dialect, upper: str, lower: str, text: str) -> str:
    """How well two colours fit a description: one up or down for each garment whose colour both name."""
    said = {"u": d.extract(f"lower({text})", r"(?:in\s+(?:a\s+)?|wearing\s+(?:a\s+)?)(\w+)\s+top"), "l": d.extract(f"lower({text})", r"(\w+)\s+(?:pants|shorts|skirt)")}
    part = lambda c, s: f"CASE WHEN {c} = 'unknown' OR {s} = '' THEN 0 WHEN {similar_colours(normal_colour(d, c), normal_colour(d, s))} THEN 1 ELSE -1 END"
    return f"({part(upper, said['u'])} + {part(lower, said['l'])})"


def hsv_colour(h: str, s: str, v: str) -> str:
    """The name of a colour: hue 0 to 180, saturation and value 0 to 255."""
    return (
        f"CASE WHEN {s} < 40 THEN CASE WHEN {v} < 30 THEN 'black' WHEN {v} < 60 THEN 'charcoal' WHEN {v} < 100 THEN 'dark gray' WHEN {v} < 130 THEN 'gray' WHEN {v} < 150 THEN 'silver' WHEN {h} BETWEEN 15 AND 35 AND {s} >= 15 THEN 'ivory' ELSE 'white' END"
        f" WHEN {v} < 40 THEN 'black' WHEN {h} < 10 OR {h} > 170 THEN CASE WHEN {v} < 100 THEN 'maroon' WHEN {s} > 150 THEN 'crimson' ELSE 'red' END WHEN {h} < 22 THEN CASE WHEN {v} < 120 THEN 'rust' ELSE 'orange' END"
        f" WHEN {h} < 35 THEN CASE WHEN {s} < 80 THEN 'khaki' WHEN {s} < 150 THEN 'gold' ELSE 'yellow' END WHEN {h} < 55 THEN CASE WHEN {v} < 120 THEN 'olive' ELSE 'green' END WHEN {h} < 78 THEN 'teal'"
        f" WHEN {h} < 95 THEN CASE WHEN {s} > 100 AND {v} > 100 THEN 'teal' WHEN {v} < 100 THEN 'navy' ELSE 'blue' END WHEN {h} < 115 THEN CASE WHEN {v} < 100 THEN 'navy' ELSE 'blue' END WHEN {h} < 131 THEN 'indigo'"
        f" WHEN {h} < 155 THEN CASE WHEN {v} < 100 THEN 'plum' ELSE 'purple' END ELSE CASE WHEN {s} < 100 THEN 'mauve' ELSE 'pink' END END"
    )


def anchor(seconds: str) -> str:
    """Where in a clip of five minutes a whole second lies, in words; tens are rounded half to even."""
    tens = f"(({seconds} - {seconds} % 10) + CASE WHEN {seconds} % 10 > 5 OR ({seconds} % 10 = 5 AND {seconds} % 20 >= 10) THEN 10 ELSE 0 END)"
    n = f"CAST({seconds} AS STRING)"
    return (
        f"CASE WHEN {seconds} < 5 THEN 'at the very start' WHEN {seconds} < 30 THEN 'about ' || {n} || ' seconds in' WHEN {seconds} < 60 THEN 'roughly ' || {n} || ' seconds in'"
        f" WHEN {seconds} < 120 THEN 'around the ' || {n} || '-second mark' WHEN {seconds} < 250 THEN 'around ' || CAST(CAST({tens} AS BIGINT) AS STRING) || ' seconds in' ELSE 'near the end of the clip' END"
    )


def garment(d: Dialect, colour: str, brightness: str, texture: str, kind: str, article: bool) -> str:
    """a dark striped navy top; an empty text for an unknown colour."""
    bright = f"CASE WHEN {brightness} IN ('', 'medium', 'unknown') OR {colour} LIKE {brightness} || '%' THEN '' ELSE {brightness} || ' ' END"
    rough = f"CASE WHEN {texture} IN ('', 'solid', 'unknown') THEN '' ELSE {texture} || ' ' END"
    made = f"({bright} || {rough} || {colour} || ' ' || {kind})"
    lead = f"CASE WHEN {d.match(made, '^[aeiou]')} THEN 'an ' ELSE 'a ' END || " if article else ""
    return f"CASE WHEN {colour} = 'unknown' THEN '' ELSE {lead}{made} END"


def described(d: Dialect) -> str:
    """The description of the columns hair, upper, lower, lower_type, shoe, brightness and texture of both, accessories."""
    up, low = garment(d, "upper", "upper_brightness", "upper_texture", "'top'", True), garment(d, "lower", "lower_brightness", "lower_texture", "lower_type", False)
    parts = [
        "CASE WHEN hair = 'unknown' THEN '' ELSE 'with ' || hair || ' hair' END",
        f"CASE WHEN upper = 'unknown' AND lower = 'unknown' THEN '' ELSE 'wearing ' || ({up}) || CASE WHEN upper <> 'unknown' AND lower <> 'unknown' THEN ' and ' ELSE '' END || ({low}) END",
        "CASE WHEN shoe = 'unknown' THEN '' ELSE shoe || ' shoes' END",
        "CASE WHEN accessories = '' THEN '' ELSE 'with ' || replace(accessories, ',', ', ') END",
    ]
    joined = "(" + " || ".join(f"CASE WHEN ({p}) = '' THEN '' ELSE ', ' || ({p}) END" for p in parts) + ")"
    return f"CASE WHEN {joined} = '' THEN 'a person' ELSE 'a person ' || substr({joined}, 3) END"

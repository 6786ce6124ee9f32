"""The chain that turns a storm catalogue into banded and labelled columns."""

from __future__ import annotations

# Class names, band edges and their labels.
TRACK_CLASSES = {
    "1": "1 北部海面西行",
    "2": "2 通過北部",
    "3": "3 通過中部",
    "4": "4 通過南部",
    "5": "5 南部海面西行",
    "6": "6 東岸北上",
    "7": "7 南部海面東行",
    "8": "8 南部海面北上",
    "9": "9 未侵襲但有影響",
    "特殊": "特殊路徑",
}
WIND_EDGES = [0, 17.2, 32.7, 51.0, 120.0]
WIND_LABELS = ["熱帶性低氣壓", "輕度颱風", "中度颱風", "強烈颱風"]
RAIN_EDGES = [0, 80, 200, 350, 500, 3000]
RAIN_LABELS = ["未達大雨", "大雨", "豪雨", "大豪雨", "超大豪雨"]
DECADE_EDGES = [1950, 1960, 1970, 1980, 1990, 2000, 2010, 2020, 2030]
DECADE_LABELS = ["1950s", "1960s", "1970s", "1980s", "1990s", "2000s", "2010s", "2020s"]


def climatology_steps(
    *, numbers, integers, wind_text: str, start: str, end: str, warned: str, lifted: str, place: str,
    rain: str, year: str, track_class: str, drop,
) -> list[dict]:
    """Steps over the named columns; every later step reads what earlier ones made."""

    def band(name: str, column: str, edges, labels, output: str) -> dict:
        return {"name": name, "use": "bin_numeric",
                "options": {"column": column, "edges": edges, "labels": labels, "output": output}}

    def span(name: str, a: str, b: str, output: str) -> dict:
        return {"name": name, "use": "duration_between",
                "options": {"start": a, "end": b, "unit": "hours", "output": output}}

    casts = {**{c: "number" for c in numbers}, **{c: "integer" for c in integers}}
    return [
        {"name": "cast", "use": "cast_types", "options": {"casts": casts}},
        {"name": "wind", "use": "parse_numeric", "options": {"column": wind_text, "output": "wind_ms"}},
        {"name": "season", "use": "datetime_parts",
         "options": {"column": start, "prefix": "genesis", "parts": ["month", "dayofyear"]}},
        span("lifetime", start, end, "lifetime_hours"),
        span("warning", warned, lifted, "sea_warning_hours"),
        {"name": "landfall", "use": "flag_rows",
         "options": {"column": place, "op": "not_empty", "output": "made_landfall"}},
        band("intensity", "wind_ms", WIND_EDGES, WIND_LABELS, "intensity_band"),
        band("rainfall", rain, RAIN_EDGES, RAIN_LABELS, "rain_band"),
        band("decade", year, DECADE_EDGES, DECADE_LABELS, "decade"),
        {"name": "classified", "use": "filter_rows", "options": {"column": track_class, "op": "not_empty"}},
        {"name": "label", "use": "map_values",
         "options": {"column": track_class, "mapping": TRACK_CLASSES, "output": "track_category"}},
        {"name": "trim", "use": "drop_columns", "options": {"columns": drop}},
    ]

"""A harbour's tables: berths and ships (some towed by another), papers one to one, routes sailed by ships, water
soundings, and a signal log without bound. Between them: a self reference, a unique foreign key, a junction of two
keys, JSON good and bad, an array, a binary and a timestamp."""

import datetime as dt
from decimal import Decimal

from docnest import Approximation, Attribute, Catalogue, Computed, Edge, Outlier, Settings, Subset, TableSpec

CATALOGUE = Catalogue.of(
    [
        TableSpec("soundings", "no"),
        TableSpec("signals", "seq"),
        TableSpec("berths", "code"),
        TableSpec("ships", "hull", unique="radio"),
        TableSpec("papers", "folio", unique="hull"),
        TableSpec("routes", "route"),
        TableSpec("sailings", ("route", "hull")),
    ],
    [
        Edge("ships", "berth", "berths", "code"),
        Edge("ships", "tug", "ships", "hull"),
        Edge("papers", "hull", "ships", "hull"),
        Edge("sailings", "route", "routes", "route"),
        Edge("sailings", "hull", "ships", "hull"),
        Edge("signals", "sender", "ships", "hull"),
    ],
)

JSON_COLUMNS = {"routes": {"chart": None}, "signals": {"body": None}}

SETTINGS = Settings(
    strategies={
        "sailings.ships": "REFERENCE",
        "sailings.routes": "REFERENCE",
        "signals.ships": "REFERENCE",
        "ships.ships": "REFERENCE",
    },
    patterns={
        "ships": [Subset("signals", 4), Outlier("signals", 3), Computed("tows", "COUNT", "ships", fk="tug")],
        "papers": [Attribute("stamps", {"issued": "issued", "flag": "flag state"})],
        "berths": [Computed("tonnage", "SUM", "ships", "tons"), Computed("moored", "COUNT", "ships")],
        "routes": [Computed("calls", "COUNT", "sailings", fk="route")],
        "soundings": [Approximation({"depth": 2})],
    },
)


def tables(spark):
    at = dt.datetime(2031, 7, 9, 4, 5, 6, 789654)
    made = {
        "berths": ("code string, metres int", [("B-east", 120), ("B-west", None)]),
        "ships": (
            "hull long, radio string, tons long, berth string, tug long",
            [(10, "ka", 700, "B-west", 30), (20, "lo", 50, None, None), (30, "mi", 90, "B-west", None), (40, "nu", 400, "B-east", 30), (50, "pe", 310, "B-east", 30)],
        ),
        "papers": ("folio long, hull long, flag string, issued date", [(7, 40, "FI", dt.date(2029, 2, 3)), (8, 10, None, dt.date(2030, 11, 12)), (9, 50, "NO", None)]),
        "routes": ("route string, chart string, sketch binary", [("north", '{"legs": [3, 5]}', bytes([9, 8])), ("south", "{oops", None)]),
        "sailings": ("route string, hull long", [("north", 10), ("north", 40), ("north", 50), ("south", 10)]),
        "soundings": (
            "no long, depth decimal(6,2), taken timestamp, echoes array<int>",
            [(1, Decimal("12.90"), at, [4]), (2, Decimal("-3.00"), None, []), (3, None, at, None), (4, Decimal("0.99"), at, [1, 2])],
        ),
        "signals": (
            "seq long, sender long, body string",
            [(i, 40, f'{{"lamp": {i}}}') for i in range(1, 6)] + [(6, 10, "dash"), (7, 10, None), (8, None, "[]")],
        ),
    }
    return {n: spark.createDataFrame(data, schema) for n, (schema, data) in made.items()}

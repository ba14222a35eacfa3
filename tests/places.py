"""Builders that several tests share."""

import json

from pyspark.sql import types as T

STORED = "id string, query string, name string, cid string, place_id string, category string, city string, state string, site string, phone string, email_1 string, full_address string, rating double, reviews long, latitude double, longitude double, first_seen long, last_seen long, email_checked_at long, email_attempts long, email_retry_at long, business_status string, verified boolean"


def stored(spark, rows):
    schema = T._parse_datatype_string(STORED)
    return spark.createDataFrame([tuple(r.get(f.name) for f in schema) for r in rows], schema)


def nest(values):
    """A positional payload: {(path): value} as nested arrays."""
    out = []
    for path, value in values.items():
        node = out
        for i, k in enumerate(path):
            while len(node) <= k:
                node.append(None)
            if i == len(path) - 1:
                node[k] = value
            else:
                if node[k] is None:
                    node[k] = []
                node = node[k]
    return out


def node(name="Acme", feature="0x1:0xff", place_id="P1", lat=49.25, lng=-123.1, ratings=9, **more):
    values = {
        (11,): name, (10,): feature, (78,): place_id, (9, 2): lat, (9, 3): lng, (2,): ["1 Main St", None, "Vancouver"], (183, 1, 0): "Downtown", (183, 1, 1): "1 Main St", (183, 1, 3): "Vancouver",
        (183, 1, 4): "V5K", (183, 1, 5): "British Columbia", (183, 1, 6): "Canada", (30,): "America/Vancouver", (7, 0): "https://www.google.com/url?q=https%3A%2F%2Facme.com%2F&sa=U", (178, 0, 0): "+1 604-555-0100",
        (13,): ["Glass shop", "Door shop", 5, "Mirror shop"], (4, 7): 4.5, (4, 2): "$$", (175, 3): [1, None, 2, 3, "40"], (203, 0): [["Monday", None, None, [["9 AM-12 PM"], ["1-5 PM"]]], ["Sunday", None, None, []], ["Tuesday", None, None, [["10 AM-4 PM"]]]],
        (88, 0): "OPERATIONAL",
    }
    if ratings > 8:
        values[4, 8] = "1,234"
    values |= {tuple(json.loads(k)): v for k, v in more.items()}
    out = nest({k: v for k, v in values.items() if v is not None})
    out[4] += [None] * (ratings - len(out[4]))
    return out


def body(*nodes):
    return ")]}'\n" + json.dumps([[None, [["header"], *[[None] * 14 + [n] for n in nodes]]]])

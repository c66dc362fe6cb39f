import sys
from pathlib import Path

import pytest
from pyspark.sql import SparkSession
from pyspark.sql import types as T

ROOT = Path(__file__).resolve().parent.parent
sys.path.insert(0, str(ROOT))

from facetra.spec import TRACKS  # noqa: E402

DEFAULT = {
    "track_id": "row-1",
    "artists": "Someone",
    "album_name": "An Album",
    "track_name": "A Title",
    "track_genre": "folk",
    "popularity": 48.0,
    "duration_ms": 201000.0,
    "explicit": False,
    "danceability": 0.44,
    "energy": 0.72,
    "key": 7.0,
    "loudness": -8.25,
    "mode": 0.0,
    "speechiness": 0.07,
    "acousticness": 0.36,
    "instrumentalness": 0.02,
    "liveness": 0.19,
    "valence": 0.53,
    "tempo": 117.0,
    "time_signature": 3.0,
}


def row(**values):
    out = {**DEFAULT, **values}
    return {k: float(v) if k in TRACKS.numeric and isinstance(v, int) else v for k, v in out.items()}


@pytest.fixture(scope="session")
def spark():
    session = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "4g")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def tracks(spark):
    """Typed track rows from overrides."""

    def build(*rows):
        fields = []
        for c, v in DEFAULT.items():
            kind = T.BooleanType() if c == "explicit" else T.DoubleType() if isinstance(v, float) else T.StringType()
            fields.append(T.StructField(c, kind))
        full = [row(**r) for r in rows]
        return spark.createDataFrame([tuple(r[c] for c in DEFAULT) for r in full], T.StructType(fields))

    return build


@pytest.fixture
def raw_tracks(spark):
    """Text-only track rows, as read from a CSV without typing."""

    def build(*rows):
        data = []
        for r in rows:
            full = {**DEFAULT, **r}
            data.append(tuple(None if full[c] is None else str(full[c]) for c in full))
        names = list({**DEFAULT, **rows[0]})
        schema = T.StructType([T.StructField(c, T.StringType()) for c in names])
        return spark.createDataFrame(data, schema)

    return build


def as_dict(df, *key, value="value"):
    keys = key or ("column",)
    return {tuple(r[k] for k in keys) if len(keys) > 1 else r[keys[0]]: r[value] for r in df.collect()}

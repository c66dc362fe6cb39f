"""Column roles.

Operators never hard-code column names: they take a :class:`FeatureSpec` that
says which columns play which role, so the same code runs on a track table, on
line items or on any other wide table of entities.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame


@dataclass(frozen=True)
class FeatureSpec:
    """Roles of the columns of one entity table."""

    key: tuple[str, ...]
    category: str
    target: str
    features: tuple[str, ...]
    name: str | None = None
    owner: str | None = None
    flag: str | None = None
    size: str | None = None  # extra positive feature used by profiling and models
    codes: tuple[str, ...] = ()  # numeric code columns, only used by classifiers
    text: tuple[str, ...] = ()
    required_text: tuple[str, ...] = ()
    numeric: tuple[str, ...] = ()
    required_numeric: tuple[str, ...] = ()
    bounded: tuple[str, ...] = ()
    positive: tuple[str, ...] = ()
    target_range: tuple[float, float] = (0.0, 100.0)
    consistent: tuple[str, ...] = ()
    weak_pair: tuple[str, str] | None = None
    order_by: str | None = None  # ingest order, when the table has one
    category_aliases: tuple[str, ...] = ()

    @property
    def expected(self) -> list[str]:
        """Every column the schema must hold, in a stable order."""
        flag = (self.flag,) if self.flag else ()
        return list(dict.fromkeys((*self.text, *self.numeric, *flag)))

    @property
    def profile_features(self) -> list[str]:
        return [*self.features, *((self.size,) if self.size else ())]

    @property
    def class_features(self) -> list[str]:
        """Features of the classifiers: profile features, flag and codes."""
        flag = (self.flag,) if self.flag else ()
        return [*self.profile_features, *flag, *self.codes]

    @property
    def categorical(self) -> list[str]:
        return [c for c in (self.category, self.owner, self.flag) if c]

    def resolve_category(self, df: DataFrame) -> str | None:
        """First of the category column and its aliases that ``df`` has."""
        for name in (self.category, *self.category_aliases):
            if name in df.columns:
                return name
        return None

    def with_roles(self, **roles) -> FeatureSpec:
        return replace(self, **roles)


# Column names of the track table.
_UNIT = (
    "danceability",
    "energy",
    "speechiness",
    "acousticness",
    "instrumentalness",
    "liveness",
    "valence",
)
TRACKS = FeatureSpec(
    key=("track_id",),
    name="track_name",
    owner="artists",
    category="track_genre",
    target="popularity",
    flag="explicit",
    size="duration_ms",
    features=(
        "danceability",
        "energy",
        "loudness",
        "speechiness",
        "acousticness",
        "instrumentalness",
        "liveness",
        "valence",
        "tempo",
    ),
    codes=("key", "mode", "time_signature"),
    text=("track_id", "artists", "album_name", "track_name", "track_genre"),
    required_text=("track_id", "artists", "track_name", "track_genre"),
    numeric=(
        "popularity",
        "duration_ms",
        "danceability",
        "energy",
        "key",
        "loudness",
        "mode",
        "speechiness",
        "acousticness",
        "instrumentalness",
        "liveness",
        "valence",
        "tempo",
        "time_signature",
    ),
    required_numeric=("duration_ms", *_UNIT, "tempo"),
    bounded=_UNIT,
    positive=("duration_ms", "tempo"),
    consistent=("danceability", "energy", "tempo", "duration_ms"),
    weak_pair=("energy", "loudness"),
    category_aliases=("genre",),
)


def require_columns(df: DataFrame, columns, what: str = "DataFrame") -> None:
    """Plan-time check; raises with the sorted missing names, runs no job."""
    missing = sorted(set(columns) - set(df.columns))
    if missing:
        raise ValueError(f"{what} is missing required columns: {', '.join(missing)}")

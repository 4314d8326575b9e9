"""Layered tables of one data set, each written once and then read by every query."""

from collections.abc import Callable, Iterable, Iterator, Mapping
from concurrent.futures import ThreadPoolExecutor
from threading import Lock

from pyspark.sql import DataFrame, SparkSession

from ..operators import cleaning, enrich, star
from ..operators.ordering import shared_folder
from ..sources.sinks import read_split, write_split, write_table


class LayerTables(Mapping):
    """The tables of one layer, each made on first use; ``build`` makes several at the same time."""

    def __init__(self, names: Iterable[str], make: Callable[[str], DataFrame]):
        self._names, self._make, self._built = list(names), make, {}
        self._locks = {name: Lock() for name in self._names}

    def build(self, names: Iterable[str]) -> list[DataFrame]:
        names = list(names)
        with ThreadPoolExecutor(max(len(names), 1)) as pool:  # the tables do not depend on each other
            return list(pool.map(self.__getitem__, names))

    def __getitem__(self, name: str) -> DataFrame:
        with self._locks[name]:
            if name not in self._built:
                self._built[name] = self._make(name)
            return self._built[name]

    def __contains__(self, name: object) -> bool:
        return name in self._locks

    def __iter__(self) -> Iterator[str]:
        return iter(self._names)

    def __len__(self) -> int:
        return len(self._names)

    def items(self):
        self.build(self._names)
        return super().items()


class Warehouse:
    """Raw, silver, gold and star layers below one folder.

    ``raw`` maps table kind to a DataFrame.  A layer is built on first use and stored as Parquet, so later
    queries scan the stored columns they need instead of cleaning and joining again.  Flagged and silver tables
    are built one by one: a query on the calendar does not wait for the listings.
    """

    def __init__(self, spark: SparkSession, raw: dict[str, DataFrame], folder: str):
        self.spark, self.raw, self.folder = spark, raw, folder
        self._layers: dict[str, dict[str, DataFrame]] = {}

    def _layer(self, name: str, build) -> dict[str, DataFrame]:
        if name not in self._layers:
            self._layers[name] = build()
        return self._layers[name]

    def _stored(self, layer: str, kind: str, df: DataFrame) -> DataFrame:
        by = ["city"] if "city" in df.columns else []  # queries on one city read its files only
        back = self.spark.read.parquet(write_table(df, f"{self.folder}/{layer}/{kind}", by))
        return back.select(*df.columns)

    @property
    def flagged(self) -> Mapping[str, DataFrame]:
        def make(kind):
            df = cleaning.clean_all({kind: self.raw[kind]}, within=["city"])[kind]
            write_split(df, f"{self.folder}/flagged", kind, ["city"])
            return read_split(self.spark, f"{self.folder}/flagged", kind, df.schema, None)
        return self._layer("flagged", lambda: LayerTables([k for k in cleaning.KINDS if k in self.raw], make))

    @property
    def silver(self) -> Mapping[str, DataFrame]:
        return self._layer("silver", lambda: LayerTables(self.flagged, lambda kind: cleaning.silver({kind: self.flagged[kind]})[kind]))

    @property
    def gold(self) -> DataFrame:
        def build():
            s = self.silver
            s.build(s)
            return {"gold": self._stored("gold", "listings", enrich.enrich(
                s["listings"], s["calendar"], s["reviews"], s["neighbourhoods"]))}
        return self._layer("gold", build)["gold"]

    @property
    def star(self) -> star.StarTables:
        def build():
            return star.StarTables(self.spark, self.gold, self.silver["calendar"], self.silver["reviews"],
                                   f"{self.folder}/star")
        return self._layer("star", build)


_open: dict[tuple[str, str], Warehouse] = {}


def warehouse(spark: SparkSession, name: str, raw) -> Warehouse:
    """The warehouse of data set ``name`` in this application; ``raw`` builds its raw tables when needed."""
    key = (spark.sparkContext.applicationId, name)
    if key not in _open:
        import hashlib
        folder = shared_folder(spark, hashlib.md5(name.encode()).hexdigest()[:12])
        _open[key] = Warehouse(spark, raw(), folder)
    return _open[key]

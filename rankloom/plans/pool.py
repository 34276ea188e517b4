"""A loaded pool: the tables of a directory in the shapes that the operators read, with the raw matrix kept."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rankloom.config import Config
from rankloom.operators import match
from rankloom.operators.evaluate import first_candidates
from rankloom.session import latest, load, materialize


class Pool:
    """Candidates, units, requirements and the raw matrix of one directory.

    Neither the units nor the raw matrix depend on any tunable, so every mode, sweep and explanation reads the one
    copy; both are written to the shared folder when first needed.
    """

    def __init__(self, spark: SparkSession, sf_dir: str, cfg: Config | None = None, limit: int | None = None):
        """``limit``: rank the first so many candidates by id only, for a quick look."""
        self.limit = limit
        self.spark, self.dir, self.cfg = spark, sf_dir, cfg or Config()
        self._ranked: dict[Config, DataFrame] = {}

    @cached_property
    def candidates(self) -> DataFrame:
        c = load(self.spark, self.dir, "candidates")
        return first_candidates(c.select(F.col("id").alias("candidate_id"), "name", "source_file", "raw_text", "skills_declared", "fit_label"), self.limit)

    @cached_property
    def units(self) -> DataFrame:
        """Evidence, one row per id (the latest), as scoring reads it; kept, as every question reads it."""
        columns = ["candidate_id", "section", "text", "normalized", "expanded", "negated"]
        units = match.prepare_units(latest(load(self.spark, self.dir, "evidence"), ["id"], columns))
        return materialize(units if self.limit is None else units.join(self.candidates.select("candidate_id"), "candidate_id", "left_semi"))

    @cached_property
    def requirements(self) -> DataFrame:
        r = load(self.spark, self.dir, "requirements")
        pos = F.coalesce(F.regexp_extract("id", r"(\d+)$", 1).try_cast("int"), F.lit(0))
        return r.select("jd_id", "req_key", pos.alias("req_pos"), "text", "kind", "aliases", "weight")

    @cached_property
    def best(self) -> DataFrame:
        return match.best_units(self.units, self.requirements, self.cfg)

    @cached_property
    def raw(self) -> DataFrame:
        return materialize(match.raw_matrix(self.best, self.candidates, self.requirements))

    def cells(self, cfg: Config | None = None) -> DataFrame:
        return match.matrix(self.raw, cfg or self.cfg)

    def scores(self, cfg: Config | None = None) -> DataFrame:
        c = cfg or self.cfg
        return match.candidate_scores(self.cells(c), self.requirements, c)

    def ranked(self, cfg: Config | None = None) -> DataFrame:
        c = cfg or self.cfg
        if c not in self._ranked:
            self._ranked[c] = match.rank_candidates(self.scores(c), self.candidates, c)
        return self._ranked[c]


TABLES = ("candidates", "evidence", "requirements")
_POOLS: dict[tuple[str, str], tuple[tuple, Pool]] = {}


def _files(spark: SparkSession, sf_dir: str) -> tuple:
    """Path, size and modification time of every file of the pool's tables."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    out = []
    for name in TABLES:
        path = jvm.org.apache.hadoop.fs.Path(f"{sf_dir}/{name}.parquet")
        fs = path.getFileSystem(conf)
        if fs.exists(path):
            files = fs.listFiles(path, True) if fs.getFileStatus(path).isDirectory() else None
            if files is None:
                found = [fs.getFileStatus(path)]
            else:
                found = []
                while files.hasNext():
                    found.append(files.next())
            out += [(f.getPath().toString(), f.getLen(), f.getModificationTime()) for f in found]
    return tuple(sorted(out))


def pool(spark: SparkSession, sf_dir: str) -> Pool:
    """The pool of a directory, one per application, made anew when a file of its tables has changed."""
    key, files = (spark.sparkContext.applicationId, sf_dir), _files(spark, sf_dir)
    if key not in _POOLS or _POOLS[key][0] != files:
        _POOLS[key] = (files, Pool(spark, sf_dir))
    return _POOLS[key][1]

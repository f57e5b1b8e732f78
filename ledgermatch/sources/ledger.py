"""The ledger's tables as one bundle of DataFrames."""

from __future__ import annotations

from dataclasses import dataclass, fields, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Attribute -> table name.
TABLES = {
    "recon": "recon_mst_trecon",
    "recon_dataset": "recon_mst_trecondataset",
    "dataset": "recon_mst_tdataset",
    "rule": "recon_mst_trule",
    "aging": "recon_mst_taging",
    "user_context": "admin_mst_tusercontext",
    "recon_context": "admin_mst_treconcontext",
    "open": "recon_trn_ttran",
    "matched": "recon_trn_ttranko",
    "breakup": "recon_trn_ttranbrkp",
    "ko": "recon_trn_tko",
    "ko_line": "recon_trn_tkodtl",
    "scheduler": "recon_trn_tscheduler",
}


#: Columns that :meth:`Ledger.write_catalog` adds: a KO's month, and what a KO line has from its KO.
KO_MONTH, LINE_RECON, LINE_MONTH = "ko_month", "line_recon_code", "line_ko_month"


def month_number(date: Column) -> Column:
    """Year and month of a date as one number, 202405 for May 2024."""
    return F.year(date) * 100 + F.month(date)


@dataclass(frozen=True)
class Ledger:
    """Masters (recon to recon_context) are configuration; the others grow with the data.

    ``open`` and ``matched`` hold one row per tran between them: a tran is in exactly one.
    """

    recon: DataFrame
    recon_dataset: DataFrame
    dataset: DataFrame
    rule: DataFrame
    aging: DataFrame
    user_context: DataFrame
    recon_context: DataFrame
    open: DataFrame
    matched: DataFrame
    breakup: DataFrame
    ko: DataFrame
    ko_line: DataFrame
    scheduler: DataFrame

    @classmethod
    def from_frames(cls, frames: dict[str, DataFrame]) -> Ledger:
        """Bundle DataFrames given under their table names."""
        return cls(**{f.name: frames[TABLES[f.name]] for f in fields(cls)})

    @classmethod
    def from_parquet(cls, spark: SparkSession, folder: str) -> Ledger:
        """One parquet table per name below ``folder``."""
        return cls.from_frames({t: spark.read.parquet(f"{folder}/{t}") for t in TABLES.values()})

    @classmethod
    def from_catalog(cls, spark: SparkSession, database: str) -> Ledger:
        return cls.from_frames({t: spark.table(f"{database}.{t}") for t in TABLES.values()})

    def write_parquet(self, folder: str) -> None:
        """Write every table; the trans are laid out by recon so that scans can skip recons."""
        plain = self.without_layout()
        for attr, name in TABLES.items():
            writer = getattr(plain, attr).write.mode("errorifexists")
            if attr in ("open", "matched"):
                writer = writer.partitionBy("recon_code")
            writer.parquet(f"{folder}/{name}")

    def write_catalog(self, database: str, buckets: int, folder: str | None = None) -> None:
        """Write every table to the catalog, laid out for reports on KOs; read it with :meth:`from_catalog`.

        KOs and their lines are partitioned by recon and month of the KO, so a report reads the months it is
        about. Lines and trans are in buckets of ``tran_gid``, so that a line meets its tran without a shuffle.
        Lines without a KO have neither recon nor month and stay in the table. Choose ``buckets`` for about 1 GB
        of trans each; a bucket is one file in each partition. ``folder`` is where the files go, the database's own
        place by default.
        """
        plain = self.without_layout()
        kos = plain.ko.withColumn(KO_MONTH, month_number(F.col("ko_date")))
        owner = kos.select("ko_gid", F.col("recon_code").alias(LINE_RECON), F.col(KO_MONTH).alias(LINE_MONTH))
        lines = plain.ko_line.join(owner, "ko_gid", "left")
        # attribute -> (rows, folders, columns of the buckets)
        layout = {
            "ko": (kos, ("recon_code", KO_MONTH), None),
            "ko_line": (lines, (LINE_RECON, LINE_MONTH), "tran_gid"),
            "open": (plain.open, ("recon_code",), "tran_gid"),
            "matched": (plain.matched, ("recon_code",), "tran_gid"),
        }
        for attr, name in TABLES.items():
            rows, folders, bucket = layout.get(attr, (getattr(plain, attr), (), None))
            if bucket:
                # As many tasks as buckets: each writes one bucket.
                rows = rows.repartition(buckets, bucket)
            writer = rows.write.format("parquet").mode("errorifexists")
            writer = writer.partitionBy(*folders) if folders else writer
            writer = writer.bucketBy(buckets, bucket) if bucket else writer
            writer = writer.option("path", f"{folder}/{name}") if folder else writer
            writer.saveAsTable(f"{database}.{name}")

    @property
    def laid_out(self) -> bool:
        """Whether KO lines carry the recon and month of their KO."""
        return LINE_MONTH in self.ko_line.columns

    def without_layout(self) -> Ledger:
        """The tables without the columns of their layout, which rows that a run adds do not have."""
        return replace(self, ko=self.ko.drop(KO_MONTH), ko_line=self.ko_line.drop(LINE_RECON, LINE_MONTH))

    def all_trans(self) -> DataFrame:
        return self.open.unionByName(self.matched)

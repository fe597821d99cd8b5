"""Settings of a database, checked when made."""

from __future__ import annotations

from dataclasses import dataclass

from tidemark.errors import InvalidArgument

CODECS = ("none", "snappy", "zstd", "lz4", "gzip")
#: "gorilla" values are packed by functions.codecs instead of a file codec.
DUPLICATES = ("append", "lww", "lww_second")


@dataclass(frozen=True)
class Config:
    """block_size: Parquet page size in bytes; cache_entries: query results kept; level: zstd level;
    codec: file codec; duplicates: what equal (series, time) rows mean when read; hot_days and warm_days: tier limits;
    batch_points and flush_ms: most rows of a stream's batch, from sources that count rows, and time between batches;
    bloom: columns with Bloom filters in the files; None: the tags given with a write.
    """

    block_size: int = 1 << 20
    cache_entries: int = 64
    cache_seconds: float = 300.0
    level: int = 3
    codec: str = "zstd"
    duplicates: str = "append"
    hot_days: int = 7
    warm_days: int = 30
    batch_points: int = 1000
    flush_ms: int = 100
    bloom: tuple[str, ...] | None = None

    def __post_init__(self) -> None:
        checks = {
            "block_size must lie in 1 KiB to 1 MiB": 1 << 10 <= self.block_size <= 1 << 20,
            "cache_entries must be positive": self.cache_entries > 0,
            "level must lie in 0 to 9": 0 <= self.level <= 9,
            f"codec must be one of {CODECS}": self.codec in CODECS,
            f"duplicates must be one of {DUPLICATES}": self.duplicates in DUPLICATES,
            "0 < hot_days < warm_days": 0 < self.hot_days < self.warm_days,
            "batch_points and flush_ms must be positive": self.batch_points > 0 and self.flush_ms > 0,
        }
        if failed := [k for k, ok in checks.items() if not ok]:
            raise InvalidArgument("; ".join(failed))

    def reader_options(self) -> dict[str, str]:
        """Options of a stream's reader, for sources that count rows."""
        return {"maxOffsetsPerTrigger": str(self.batch_points), "rowsPerBatch": str(self.batch_points)}

    def every(self) -> str:
        """Time between a stream's batches."""
        return f"{self.flush_ms} milliseconds"

    def writer_options(self, tags: tuple[str, ...] = ()) -> dict[str, str]:
        """Options of the Parquet writer."""
        options = {"compression": self.codec, "parquet.page.size": str(self.block_size), "parquet.compression.codec.zstd.level": str(max(1, self.level))}
        return options | {f"parquet.bloom.filter.enabled#{c}": "true" for c in (tags if self.bloom is None else self.bloom)}

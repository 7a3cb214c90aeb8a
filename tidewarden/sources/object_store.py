"""S3-compatible stores, as session options and paths."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import SparkSession


@dataclass(frozen=True)
class ObjectStore:
    """A bucket. Credentials are not part of it: they come from the ambient provider chain."""

    bucket: str
    prefix: str = ""
    region: str = ""
    endpoint: str = ""
    path_style: bool = False

    def __post_init__(self) -> None:
        if not self.bucket:
            raise ValueError("an object store needs a bucket")


def object_store_conf(store: ObjectStore) -> dict[str, str]:
    """Per-bucket `fs.s3a` options, so several stores can be used in one session."""
    base = f"fs.s3a.bucket.{store.bucket}"
    conf = {f"{base}.path.style.access": str(store.path_style).lower()}
    if store.endpoint:
        conf[f"{base}.endpoint"] = store.endpoint
        conf[f"{base}.connection.ssl.enabled"] = str(not store.endpoint.startswith("http://")).lower()
    if store.region:
        conf[f"{base}.endpoint.region"] = store.region
    return conf


def object_store_path(store: ObjectStore, *parts: str) -> str:
    pieces = [p.strip("/") for p in (store.prefix, *parts)]
    return "/".join([f"s3a://{store.bucket}", *[p for p in pieces if p]])


def use_object_store(spark: SparkSession, store: ObjectStore) -> str:
    """Apply the options to the running session and return the store's root path."""
    for key, value in object_store_conf(store).items():
        spark.sparkContext._jsc.hadoopConfiguration().set(key, value)
    return object_store_path(store)

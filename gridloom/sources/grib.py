"""Gridded weather files (GRIB editions 1 and 2, regular latitude-longitude grids, simple packing) as rows.

Files come through Spark's binary reader, so they may stand wherever Spark can read; a task decodes whole messages with
numpy and keeps only the cells of the area that is asked for, so an area never costs more rows than it has. A tar
archive of such files is opened in memory. Rows: path, member (of an archive), message (from 1), edition, parameter,
level, run and step in hours, valid_hour (hours since 1970-01-01), i, j, lat, lon, value (null where a bitmap says so).

Defined cases: bytes that are no message are passed over; a message of another grid or packing raises an error that
names the file; an empty folder gives no rows.
"""

from __future__ import annotations

import io
import struct
import tarfile
from collections.abc import Iterator
from datetime import UTC, datetime

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .tables import first_present

SCHEMA = "path string, member string, message int, edition int, parameter string, level int, run_hour long, step int, valid_hour long, i int, j int, lat double, lon double, value double"
#: Parameter numbers (edition 1, table 128) and category.number at a level in metres or none (edition 2), and the variables' names.
VARIABLES = {"128.246": "Uwind", "128.247": "Vwind", "128.167": "Temperature", "128.164": "Cloud", "128.169": "Flux", "128.33": "Uwind", "128.34": "Vwind", "0.2.2": "Uwind", "0.2.3": "Vwind", "0.0.0": "Temperature", "0.6.1": "Cloud", "0.4.7": "Flux", "0.1.8": "Precipitation"}
#: Places of messages within an hourly file of the second provider, by resolution.
PLACES = {0.05: {21: "Uwind", 22: "Vwind"}, None: {1: "Uwind", 2: "Vwind"}}
COMMON_PLACES = {3: "Temperature", 7: "Precipitation", 5: "Cloud", 8: "Flux"}


def _signed(raw: bytes) -> int:
    """Sign and magnitude."""
    n = int.from_bytes(raw, "big")
    top = 1 << (8 * len(raw) - 1)
    return -(n - top) if n & top else n


def _ibm(raw: bytes) -> float:
    n = int.from_bytes(raw, "big")
    value = (n & 0xFFFFFF) / float(1 << 24) * 16.0 ** (((n >> 24) & 0x7F) - 64)
    return -value if n >> 31 else value


def _unpacked(data: bytes, bits: int, n: int) -> np.ndarray:
    """n unsigned numbers of `bits` bits each, most significant first."""
    if not bits:
        return np.zeros(n)
    flags = np.unpackbits(np.frombuffer(data, np.uint8), count=n * bits).reshape(n, bits)
    return flags @ (1 << np.arange(bits - 1, -1, -1, dtype=np.int64)).astype(np.float64)


def _hour(*when: int) -> int:
    return int(datetime(*when, tzinfo=UTC).timestamp()) // 3600


def _grid(ni: int, nj: int, first: tuple[float, float], last: tuple[float, float], scan: int) -> tuple[np.ndarray, ...]:
    """i, j, lat, lon of the points in the order in which their values stand."""
    lon = np.linspace(first[1], last[1], ni)
    lat = np.linspace(first[0], last[0], nj)
    i, j = np.meshgrid(np.arange(ni), np.arange(nj))
    if scan & 0x20:  # columns are consecutive
        i, j = i.T, j.T
    i, j = i.ravel(), j.ravel()
    return i, j, lat[j], lon[i]


def _edition_1(raw: bytes) -> dict:
    at = 8
    size = int.from_bytes(raw[at : at + 3], "big")
    pds = raw[at : at + size]
    year = (pds[24] - 1) * 100 + pds[12]
    step = pds[18] if pds[20] not in (2, 3, 4, 5) else pds[19]
    if pds[20] == 10:
        step = int.from_bytes(pds[18:20], "big")
    step *= {1: 1, 10: 3, 11: 6, 12: 12, 2: 24}.get(pds[17], 1)
    scale = _signed(pds[26:28])
    at += size
    if not pds[7] & 0x80:
        raise ValueError("a message without a grid")
    size = int.from_bytes(raw[at : at + 3], "big")
    gds = raw[at : at + size]
    if gds[5] != 0:
        raise ValueError(f"grid of kind {gds[5]}")
    ni, nj = int.from_bytes(gds[6:8], "big"), int.from_bytes(gds[8:10], "big")
    milli = lambda k: _signed(gds[k : k + 3]) / 1000
    places = _grid(ni, nj, (milli(10), milli(13)), (milli(17), milli(20)), gds[27])
    at += size
    present = None
    if pds[7] & 0x40:
        size = int.from_bytes(raw[at : at + 3], "big")
        present = np.unpackbits(np.frombuffer(raw[at + 6 : at + size], np.uint8))[: ni * nj].astype(bool)
        at += size
    size = int.from_bytes(raw[at : at + 3], "big")
    bds = raw[at : at + size]
    if bds[3] & 0xD0:
        raise ValueError("packing other than simple")
    n = ni * nj if present is None else int(present.sum())
    x = (_ibm(bds[6:10]) + _unpacked(bds[11:], bds[10], n) * 2.0 ** _signed(bds[4:6])) / 10.0**scale
    run = _hour(year, pds[13], pds[14], pds[15])
    return {"parameter": f"{pds[3]}.{pds[8]}", "level": int.from_bytes(pds[10:12], "big"), "run": run, "step": step, "places": places, "present": present, "x": x}


def _edition_2(raw: bytes) -> dict:
    at, s = 16, {}
    while raw[at : at + 4] != b"7777":
        size, number = struct.unpack(">IB", raw[at : at + 5])
        s[number] = raw[at : at + size]
        at += size
    year, month, day, hour = struct.unpack(">HBBB", s[1][12:17])
    if (grid := struct.unpack(">H", s[3][12:14])[0]) != 0:
        raise ValueError(f"grid of kind {grid}")
    if (packing := struct.unpack(">H", s[5][9:11])[0]) != 0:
        raise ValueError(f"packing of kind {packing}")
    ni, nj = struct.unpack(">II", s[3][30:38])
    micro = lambda k: _signed(s[3][k : k + 4]) / 1e6
    places = _grid(ni, nj, (micro(46), micro(50)), (micro(55), micro(59)), s[3][71])
    step = struct.unpack(">I", s[4][18:22])[0] * {1: 1, 10: 3, 11: 6, 12: 12, 2: 24}.get(s[4][17], 1)
    present = np.unpackbits(np.frombuffer(s[6][6:], np.uint8))[: ni * nj].astype(bool) if s[6][5] == 0 else None
    low, bits = struct.unpack(">f", s[5][11:15])[0], s[5][19]
    n = ni * nj if present is None else int(present.sum())
    x = (low + _unpacked(s[7][5:], bits, n) * 2.0 ** _signed(s[5][15:17])) / 10.0 ** _signed(s[5][17:19])
    return {"parameter": f"{raw[6]}.{s[4][9]}.{s[4][10]}", "level": int.from_bytes(s[4][24:28], "big"), "run": _hour(year, month, day, hour), "step": step, "places": places, "present": present, "x": x}


def messages(raw: bytes) -> Iterator[tuple[int, dict]]:
    """(edition, message) of a file's bytes, in order."""
    at = raw.find(b"GRIB")
    while at >= 0:
        edition = raw[at + 7]
        size = int.from_bytes(raw[at + 4 : at + 7], "big") if edition == 1 else int.from_bytes(raw[at + 8 : at + 16], "big")
        yield edition, (_edition_1 if edition == 1 else _edition_2)(raw[at : at + size])
        at = raw.find(b"GRIB", at + max(size, 4))


def members(raw: bytes) -> Iterator[tuple[str, bytes]]:
    """The files of a (compressed) tar archive, or the one file itself."""
    if raw[:4] == b"GRIB" or not (raw[:2] == b"\x1f\x8b" or raw[257:262] == b"ustar"):
        yield "", raw
        return
    with tarfile.open(fileobj=io.BytesIO(raw)) as tar:
        for entry in sorted((e for e in tar.getmembers() if e.isfile()), key=lambda e: e.name):
            yield entry.name, tar.extractfile(entry).read()


def read(spark: SparkSession, path: str | list[str], area: tuple[float, float, float, float] | None = None, recursive: bool = False) -> DataFrame:
    """Rows of the files at the path(s); area: (least lat, most lat, least lon, most lon), applied within the decoder."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [c.split()[0] for c in SCHEMA.split(", ")]
        for batch in batches:
            for name, content in zip(batch.column("path").to_pylist(), batch.column("content"), strict=True):
                for member, raw in members(content.as_py()):
                    try:
                        for k, (edition, m) in enumerate(messages(raw), 1):
                            i, j, lat, lon = m["places"]
                            value = np.full(len(i), np.nan)
                            value[slice(None) if m["present"] is None else m["present"]] = m["x"]
                            keep = np.ones(len(i), bool) if area is None else (lat >= area[0]) & (lat <= area[1]) & (lon >= area[2]) & (lon <= area[3])
                            n = int(keep.sum())
                            same = [[name] * n, [member] * n, np.full(n, k, np.int32), np.full(n, edition, np.int32), [m["parameter"]] * n, np.full(n, m["level"], np.int32), np.full(n, m["run"]), np.full(n, m["step"], np.int32), np.full(n, m["run"] + m["step"])]
                            own = [i[keep].astype(np.int32), j[keep].astype(np.int32), lat[keep], lon[keep], pa.array(value[keep], from_pandas=True)]
                            yield pa.RecordBatch.from_arrays([pa.array(c) for c in same] + [c if isinstance(c, pa.Array) else pa.array(c) for c in own], names)
                    except (ValueError, IndexError, struct.error) as e:
                        raise ValueError(f"{name} {member}: {e}") from e

    files = spark.read.format("binaryFile").option("recursiveFileLookup", recursive).load(path).select("path", "content")
    return files.mapInArrow(run, SCHEMA)


def variable_of(parameter: Column) -> Column:
    """The variable's name; null for others."""
    table = F.create_map(*[F.lit(x) for pair in VARIABLES.items() for x in pair])
    return F.try_element_at(table, parameter)


def fields(rows: DataFrame, variable: Column | None = None) -> DataFrame:
    """run_hour, valid_hour, i, j, lat, lon and a column for each variable, with the wind's speed and direction."""
    from ..functions.scalars import wind_direction, wind_speed

    names = ["Uwind", "Vwind", "Temperature", "Cloud", "Flux", "Precipitation"]
    v = variable_of(F.col("parameter")) if variable is None else variable
    wide = rows.withColumn("v", v).groupBy("run_hour", "valid_hour", "i", "j", "lat", "lon").agg(*[F.max(F.when(F.col("v") == n, F.col("value"))).alias(n) for n in names])
    return wide.withColumns({"WS": wind_speed(F.col("Uwind"), F.col("Vwind")), "WD": wind_direction(F.col("Uwind"), F.col("Vwind"))})


def by_place(resolution: float) -> Column:
    """The variable by the place of its message in an hourly file, for providers whose messages have an order."""
    places = {**PLACES.get(resolution, PLACES[None]), **COMMON_PLACES}
    return F.try_element_at(F.create_map(*[F.lit(x) for pair in places.items() for x in pair]), F.col("message"))


def at_point(rows: DataFrame, lat: float, lon: float, within: float = 0.001) -> DataFrame:
    """The rows of one cell."""
    return rows.filter((F.abs(F.col("lat") - lat) <= within) & (F.abs(F.col("lon") - lon) <= within))


def day(spark: SparkSession, root: str, name: str, area: tuple[float, float, float, float] | None = None) -> DataFrame | None:
    """A run's rows from the first layout that is there: one file, an archive, or a folder of hourly files; None if there is none."""
    found = first_present(spark, [f"{root}/{name}.grib", f"{root}/{name}.tgz", f"{root}/{name}"])
    return None if found is None else read(spark, found, area, recursive=True)


def days(spark: SparkSession, root: str, names: list[str], area: tuple[float, float, float, float] | None = None) -> DataFrame:
    """The runs that are there, together; the list of days is the caller's (one path lookup each), the files are read as one job."""
    found = [p for name in names if (p := first_present(spark, [f"{root}/{name}.grib", f"{root}/{name}.tgz", f"{root}/{name}"]))]
    return read(spark, found, area, recursive=True) if found else spark.createDataFrame([], SCHEMA)


def hourly_runs(spark: SparkSession, glob: str, resolution: float, area: tuple[float, float, float, float], pattern: str = r"_(\d{3})[^/]*$") -> DataFrame:
    """Fields of a provider with one file for each forecast hour; `pattern` finds the hour in the file's name."""
    rows = read(spark, glob, area)
    step = F.regexp_extract("path", pattern, 1).cast("long")
    return fields(rows.withColumn("valid_hour", F.col("run_hour") + step), by_place(resolution))

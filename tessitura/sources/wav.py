"""WAV, AIFF and FLAC files: heads (with `smpl` loops), frames as numbers, and 32-bit float WAV files."""

from __future__ import annotations

import struct
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessitura.sources import adpcm, flac

INFO = "rate int, channels int, bits int, frames long, loop_start long, loop_end long, loops int"


class WavError(ValueError):
    """A file that is no WAV file, or of an encoding that isn't supported."""


#: Bytes of a chunk besides samples that are read at most.
CHUNK = 4096


def info(data: bytes) -> dict:
    """Format, frames and the first forward loop of a file; a loop's end is exclusive."""
    return header(lambda at, n: data[at : at + n], len(data))


def header(read: Callable[[int, int], bytes], length: int) -> dict:
    """The same of a file that read(place, bytes) gives a part of: only the chunks' heads and the small chunks are read."""
    first = read(0, 12)
    if first[:4] == b"fLaC":
        return flac.header(read, length)
    if first[:4] == b"FORM" and first[8:12] in (b"AIFF", b"AIFC"):
        return _aiff_header(read, length)
    if first[:4] != b"RIFF" or first[8:12] != b"WAVE":
        raise WavError("no RIFF/WAVE header")
    out = {"rate": None, "channels": None, "bits": None, "frames": 0, "loop_start": None, "loop_end": None, "loops": 0, "kind": None, "start": 0, "size": 0}
    at = 12
    while at + 8 <= length:
        name, size = struct.unpack("<4sI", read(at, 8))
        start, size = at + 8, min(size, length - at - 8)
        body = b"" if name == b"data" else read(start, min(size, CHUNK))
        if name == b"fmt ":
            out["kind"], out["channels"], out["rate"], _, _, out["bits"] = struct.unpack_from("<HHIIHH", body)
            if out["kind"] == 0xFFFE and size >= 40:
                out["kind"] = struct.unpack_from("<H", body, 24)[0]
            elif out["kind"] in (adpcm.MICROSOFT, adpcm.IMA):
                out |= _blocked(body, out["kind"], out["channels"])
        elif name == b"fact" and size >= 4:
            out["stated"] = struct.unpack_from("<I", body)[0]
        elif name == b"loud":
            out["loud"] = adpcm.loud_heads(read(start, size))
        elif name == b"data":
            out["start"], out["size"] = start, size
        elif name == b"smpl":
            out["loops"], loop = flac.smpl_loop(body)
            if loop:
                out["loop_start"], out["loop_end"] = loop
        at = start + size + size % 2
    if not out["channels"] or not out["bits"]:
        raise WavError("no format chunk")
    if "per_block" in out:
        whole, rest = divmod(out["size"], out["align"])
        out["frames"] = whole * out["per_block"] + max(0, min(out["per_block"], adpcm.frames_of(out["kind"], rest, out["channels"])) if rest else 0)
        out["frames"] = min(out["frames"], out.get("stated", out["frames"]))
    else:
        out["frames"] = out["size"] // (out["channels"] * out["bits"] // 8)
    return out


def _blocked(body: bytes, kind: int, channels: int) -> dict:
    """What a format of ADPCM blocks states besides: their bytes and frames, and Microsoft's pairs of coefficients."""
    align = struct.unpack_from("<H", body, 12)[0]
    out = {"align": align, "per_block": struct.unpack_from("<H", body, 18)[0] if len(body) >= 20 else 0, "pairs": adpcm.PAIRS}
    most = adpcm.frames_of(kind, align, channels) if align else 0
    if most < 1:
        raise WavError("blocks without frames")
    out["per_block"] = min(out["per_block"] or most, most)
    if kind == adpcm.MICROSOFT and len(body) >= 22:
        n = struct.unpack_from("<H", body, 20)[0]
        if len(body) >= 22 + 4 * n:
            out["pairs"] = tuple(struct.iter_unpack("<hh", body[22 : 22 + 4 * n]))
    return out


def stretch(read: Callable[[int, int], bytes], about: dict, first: int, count: int) -> np.ndarray:
    """(frames, channels) in -1..1 of `count` frames from `first` on; only the bytes that hold them are read."""
    count = max(0, min(count, about["frames"] - first))
    if about["kind"] == "flac":
        return flac.decoded(read, about, first, count)
    if "per_block" in about:
        return adpcm.decoded(read, about, first, count)
    width = about["channels"] * about["bits"] // 8
    return decoded(read(about["start"] + first * width, count * width), about)


def samples(data: bytes) -> tuple[np.ndarray, dict]:
    """(frames, channels) in -1..1 and the file's info."""
    about = info(data)
    return stretch(lambda at, n: data[at : at + n], about, 0, about["frames"]), about


#: Sample encodings of AIFF files by their four characters: WAV's number of the kind, and the order of bytes: fixed values.
AIFF_KINDS = {b"NONE": (1, ">"), b"twos": (1, ">"), b"sowt": (1, "<"), b"fl32": (3, ">"), b"FL32": (3, ">"), b"fl64": (3, ">"), b"FL64": (3, ">")}


def _extended(b: bytes) -> float:
    """An 80-bit number: sign and exponent in two bytes, then 64 bits with the leading one."""
    power, value = struct.unpack(">HQ", b)
    return value * 2.0 ** ((power & 0x7FFF) - 16383 - 63) * (-1 if power & 0x8000 else 1)


def _aiff_header(read: Callable[[int, int], bytes], length: int) -> dict:
    """What header gives, of an AIFF or AIFC file; `order` is that of its bytes."""
    out = {"rate": None, "channels": None, "bits": None, "frames": 0, "loop_start": None, "loop_end": None, "loops": 0, "kind": None, "start": 0, "size": 0, "order": ">"}
    at = 12
    while at + 8 <= length:
        name, size = struct.unpack(">4sI", read(at, 8))
        start, size = at + 8, min(size, length - at - 8)
        if name == b"COMM":
            body = read(start, min(size, CHUNK))
            out["channels"], out["frames"], out["bits"] = struct.unpack_from(">HIH", body)
            out["rate"] = round(_extended(body[8:18]))
            code = body[18:22] if size >= 22 else b"NONE"
            if code not in AIFF_KINDS:
                raise WavError(f"encoding {code!r} isn't supported")
            out["kind"], out["order"] = AIFF_KINDS[code]
        elif name == b"SSND":
            out["start"] = start + 8 + struct.unpack(">I", read(start, 4))[0]
            out["size"] = start + size - out["start"]
        at = start + size + size % 2
    if not out["channels"] or not out["bits"]:
        raise WavError("no format chunk")
    out["bits"] = -(-out["bits"] // 8) * 8
    out["frames"] = min(out["frames"], out["size"] // (out["channels"] * out["bits"] // 8))
    return out


def decoded(raw: bytes, about: dict) -> np.ndarray:
    """(frames, channels) of a stretch of whole frames of a file."""
    kind, bits = about["kind"], about["bits"]
    if about.get("order") == ">":  # turned around; single bytes are signed here
        raw = np.frombuffer(raw, np.uint8).reshape(-1, bits // 8)[:, ::-1].tobytes()
    if "order" in about and bits == 8:
        return (np.frombuffer(raw, np.int8) / 128.0).reshape(-1, about["channels"])
    if kind == 3 and bits in (32, 64):
        x = np.frombuffer(raw, "<f4" if bits == 32 else "<f8").astype(float)
    elif kind == 1 and bits == 8:
        x = (np.frombuffer(raw, np.uint8).astype(float) - 128) / 128
    elif kind == 1 and bits in (16, 32):
        x = np.frombuffer(raw, "<i2" if bits == 16 else "<i4") / float(1 << (bits - 1))
    elif kind == 1 and bits == 24:
        b = np.frombuffer(raw, np.uint8).reshape(-1, 3).astype(np.int32)
        x = ((b[:, 0] | b[:, 1] << 8 | b[:, 2] << 16) << 8 >> 8) / float(1 << 23)
    else:
        raise WavError(f"encoding {kind} with {bits} bits isn't supported")
    return x.reshape(-1, about["channels"])


def wav_bytes(x: np.ndarray, rate: int, loop: tuple[int, int] | None = None) -> bytes:
    """A 32-bit float file of (frames, channels)."""
    body = np.ascontiguousarray(x, "<f4").tobytes()
    channels = x.shape[1]
    fmt = struct.pack("<HHIIHH", 3, channels, rate, rate * channels * 4, channels * 4, 32)
    parts = [b"fmt " + struct.pack("<I", len(fmt)) + fmt, b"data" + struct.pack("<I", len(body)) + body]
    if loop:
        smpl = struct.pack("<9I", 0, 0, int(1e9 / rate), 60, 0, 0, 0, 1, 0) + struct.pack("<6I", 0, 0, loop[0], loop[1] - 1, 0, 0)
        parts.append(b"smpl" + struct.pack("<I", len(smpl)) + smpl)
    whole = b"WAVE" + b"".join(parts)
    return b"RIFF" + struct.pack("<I", len(whole)) + whole


def read_info(spark: SparkSession, path: str) -> DataFrame:
    """(path, rate, channels, bits, frames, loop_start, loop_end, loops) of each file below path; of a file only its heads are read."""
    register(spark)
    return spark.read.format("wav").option("info", "true").load(path)


def read_frames(spark: SparkSession, path: str, block: int = 65536, first: int = 0, count: int | None = None) -> DataFrame:
    """(path, rate, first_frame, channels, samples): interleaved blocks of each file, in the order of frames; `first` and `count`
    limit the frames, and no others are read."""
    register(spark)
    reader = spark.read.format("wav").option("block", str(block)).option("first", str(first))
    return (reader if count is None else reader.option("count", str(count))).load(path)


def register(spark: SparkSession) -> None:
    """Makes the format `wav` known to a session, for spark.read and df.write."""
    from tessitura.sources.wavsource import WavSource

    spark.dataSource.register(WavSource)


def decoded_contents(files: DataFrame, key: str, block: int = 65536) -> DataFrame:
    """(key, rate, first_frame, channels, samples) of files(key, content) held as bytes in a table, of any format that can be read."""
    kind = files.schema[key].dataType.simpleString()

    def run(batches):
        for batch in batches:
            for own, data in zip(batch.column(0), batch.column(1)):
                data = data.as_py()
                about = info(data)
                for a in range(0, about["frames"], block):
                    x = stretch(lambda at, n: data[at : at + n], about, a, block)
                    row = [pa.array([own.as_py()], batch.schema.field(0).type), pa.array([about["rate"]], pa.int32()), pa.array([a], pa.int64()), pa.array([x.shape[1]], pa.int32())]
                    yield pa.RecordBatch.from_arrays([*row, pa.array([x.reshape(-1)], pa.list_(pa.float64()))], [key, "rate", "first_frame", "channels", "samples"])

    return files.select(key, "content").mapInArrow(run, f"`{key}` {kind}, rate int, first_frame long, channels int, samples array<double>")


def as_signal(blocks: DataFrame, key: str = "path") -> DataFrame:
    """(key, frame, l, r) of blocks: one channel goes to both sides, of several the first two count."""
    at = lambda i, k: F.get("samples", (i * F.col("channels") + F.least(F.lit(k), F.col("channels") - 1)).cast("int"))
    n = (F.size("samples") / F.col("channels")).cast("int")
    rows = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.struct((F.col("first_frame") + i).alias("frame"), at(i, 0).alias("l"), at(i, 1).alias("r")))
    return blocks.filter("size(samples) > 0").select(key, F.inline(rows))


def rendered(signal: DataFrame, key: str, rate: int, seconds: int | None = None, form: str = "float", align: int = 1024) -> DataFrame:
    """(key, frames, content): one file's bytes for each key; with `seconds` cut to whole seconds. `form` is float (32-bit WAV), flac or
    adpcm (16 bits each; `align` bytes a block); FLAC files have room for what passes full scale, and ADPCM blocks start with it. A file is as large as one task must hold; format("wav") writes longer ones."""
    if seconds is not None:
        signal = signal.filter(F.col("frame") < seconds * rate)
    if form not in ("float", "flac", "adpcm"):
        raise WavError(f"no form {form!r} to write")
    kind = signal.schema[key].dataType.simpleString()

    def write(part: pa.Table) -> pa.Table:
        frame = part["frame"].to_numpy()
        x = np.zeros((int(frame.max()) + 1, 2))
        x[frame, 0], x[frame, 1] = part["l"].to_numpy(), part["r"].to_numpy()
        whole = np.clip(np.round(x * 32768), -1 << 31, (1 << 31) - 1).astype(np.int64)
        content = wav_bytes(x, rate) if form == "float" else flac.encoded_loud(whole, rate) if form == "flac" else adpcm.ima_encoded(whole, rate, align)
        return pa.table({key: part[key].slice(0, 1), "frames": pa.array([len(x)], pa.int64()), "content": pa.array([content], pa.binary())})

    cut = signal.select(key, "frame", "l", "r")
    return cut.groupBy(key).applyInArrow(write, f"`{key}` {kind}, frames long, content binary")

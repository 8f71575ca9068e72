"""Audio and loss models: codecs, levels, mixing, envelopes, two-state loss."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import BinaryType


def rms(samples: Column) -> Column:
    n = F.size(samples)
    return F.when(n > 0, F.sqrt(F.aggregate(samples, F.lit(0.0), lambda a, x: a + x.cast("double") * x) / n)).otherwise(0.0)


#: The speech level that ratios refer to, and the level below which noise is silence.
SPEECH_RMS = 3000.0
LEAST_RMS = 1e-6


def noise_scale(noise: Column, snr_db: Column) -> Column:
    """The factor that brings noise of that level to the wanted ratio to the reference speech; 0 for silence."""
    return F.when(noise < LEAST_RMS, 0.0).otherwise(F.lit(SPEECH_RMS) / noise * F.pow(F.lit(10.0), -snr_db / 20))


def mix(a: Column, b: Column, gain: float = 1.0) -> Column:
    """Sum of two tracks, the shorter padded with silence, clipped to 16 bits."""
    s = F.zip_with(a, b, lambda x, y: F.coalesce(x, F.lit(0)).cast("double") + F.coalesce(y, F.lit(0)).cast("double") * gain)
    return F.transform(s, lambda x: F.greatest(F.lit(-32768.0), F.least(F.lit(32767.0), x)).cast("int"))


def snr_envelope(t: Column, speed: float, snr_db: float, drift_db: float, *waves: tuple[float, float]) -> Column:
    """Level at time t: sines of (amplitude, frequency), scaled to one by the sum of amplitudes, around ``snr_db``."""
    total = sum(a for a, _ in waves)
    wave = sum((F.sin(t * (2 * math.pi * speed * f)) * a for a, f in waves), F.lit(0.0))
    return wave / total * drift_db + snr_db


#: Fixed value: the share of packets that the bad state of the loss model loses.
BAD_LOSS = 0.2


def gilbert_elliott(loss: float, burst_ms: float, bad_loss: float = BAD_LOSS) -> dict[str, float]:
    """Transition rates a second of the two-state loss model, and its share of time in the bad state."""
    if not 0 <= loss < bad_loss or burst_ms <= 0:
        raise ValueError("loss must be below that of the bad state, bursts longer than nothing")
    r = 1000.0 / burst_ms
    p = r * loss / (bad_loss - loss)
    return {"r_rate": r, "p_rate": p, "bad_share": p / (p + r)}


def loss_rates(loss: Column, burst_ms: Column, bad_loss: float = BAD_LOSS) -> Column:
    """:func:`gilbert_elliott` of columns, as a struct; a loss that the bad state can't make has no rate into it."""
    fits = (loss >= 0) & (loss < bad_loss)
    r = F.try_divide(F.lit(1000.0), F.when(burst_ms > 0, burst_ms))
    return F.struct(r.alias("r_rate"), F.when(fits, r * loss / (F.lit(bad_loss) - loss)).alias("p_rate"), F.when(fits, loss / bad_loss).alias("bad_share"))


def loss_chain(n: int, loss: float, burst_ms: float, seed: int, packet_s: float = 0.02, good_loss: float = 0.0, bad_loss: float = BAD_LOSS) -> list[bool]:
    """Whether each of n packets is lost: the chain itself, for one stream."""
    m, rng, bad, out = gilbert_elliott(loss, burst_ms, bad_loss), np.random.default_rng(seed), False, []
    for u, v in rng.random((n, 2)):
        bad = bad ^ bool(u < 1 - math.exp(-(m["r_rate"] if bad else m["p_rate"]) * packet_s))
        out.append(bool(v < (bad_loss if bad else good_loss)))
    return out


_BIAS, _TOP = 132, 32635


def _encode(x: np.ndarray) -> np.ndarray:
    sign = np.where(x < 0, 0x80, 0)
    m = np.minimum(np.abs(x.astype(np.int32)), _TOP) + _BIAS
    exponent = np.floor(np.log2(m)).astype(np.int32) - 7
    return (~(sign | exponent << 4 | (m >> (exponent + 3)) & 15) & 0xFF).astype(np.uint8)


def _decode(b: np.ndarray) -> np.ndarray:
    b = ~b.astype(np.int32) & 0xFF
    m = (((b & 15) << 3) + _BIAS << (b >> 4 & 7)) - _BIAS
    return np.where(b & 0x80, -m, m).astype(np.int16)


@pandas_udf(BinaryType())
def to_mulaw(pcm: pd.Series) -> pd.Series:
    """16-bit little-endian samples as 8-bit mu-law."""
    return pcm.map(lambda x: None if x is None else _encode(np.frombuffer(x, "<i2")).tobytes())


@pandas_udf(BinaryType())
def from_mulaw(data: pd.Series) -> pd.Series:
    return data.map(lambda x: None if x is None else _decode(np.frombuffer(x, np.uint8)).astype("<i2").tobytes())


@pandas_udf(BinaryType())
def to_mono(pcm: pd.Series) -> pd.Series:
    """Two interleaved channels as their mean."""
    return pcm.map(lambda x: None if x is None else np.frombuffer(x, "<i2").reshape(-1, 2).astype(np.int32).mean(1).astype("<i2").tobytes())


def resampler(source_rate: int, target_rate: int):
    """A UDF that resamples by linear interpolation."""

    @pandas_udf(BinaryType())
    def resample(pcm: pd.Series) -> pd.Series:
        def one(x):
            if x is None:
                return None
            s = np.frombuffer(x, "<i2").astype(float)
            n = int(round(len(s) * target_rate / source_rate))
            return np.interp(np.arange(n) * source_rate / target_rate, np.arange(len(s)), s).round().astype("<i2").tobytes() if len(s) else b""

        return pcm.map(one)

    return resample


def drop_frames(frame_bytes: int, loss: float, burst_ms: float, seed: int):
    """A UDF that silences the frames that the two-state model loses."""

    @pandas_udf(BinaryType())
    def run(pcm: pd.Series) -> pd.Series:
        def one(x):
            if x is None:
                return None
            out = bytearray(x)
            for k, lost in enumerate(loss_chain(-(-len(x) // frame_bytes), loss, burst_ms, seed)):
                if lost:
                    out[k * frame_bytes : (k + 1) * frame_bytes] = bytes(len(out[k * frame_bytes : (k + 1) * frame_bytes]))
            return bytes(out)

        return pcm.map(one)

    return run


def _alaw(x: np.ndarray) -> np.ndarray:
    """13-bit magnitudes in eight segments of sixteen steps, even bits inverted."""
    v = x.astype(np.int32) >> 3
    sign = np.where(v >= 0, 0xD5, 0x55)
    m = np.where(v >= 0, v, -v - 1)
    segment = np.maximum(np.floor(np.log2(np.maximum(m, 1))).astype(np.int32) - 4, 0)
    step = np.where(segment < 2, m >> 1, m >> np.maximum(segment, 1)) & 15
    return (((segment << 4) | step) ^ sign).astype(np.uint8)


def _from_alaw(b: np.ndarray) -> np.ndarray:
    a = b.astype(np.int32) ^ 0x55
    segment, step = (a >> 4) & 7, a & 15
    m = np.where(segment == 0, (step << 4) + 8, ((step << 4) + 0x108) << np.maximum(segment - 1, 0))
    return np.where(a & 0x80, m, -m).astype(np.int16)


def _each(f):
    """A function of 16-bit samples as a UDF over batches of tracks."""

    @pandas_udf(BinaryType())
    def run(pcm: pd.Series) -> pd.Series:
        return pcm.map(lambda x: None if x is None else np.clip(np.round(f(np.frombuffer(x, "<i2").astype(float))), -32768, 32767).astype("<i2").tobytes())

    return run


@pandas_udf(BinaryType())
def to_alaw(pcm: pd.Series) -> pd.Series:
    """16-bit little-endian samples as 8-bit A-law."""
    return pcm.map(lambda x: None if x is None else _alaw(np.frombuffer(x, "<i2")).tobytes())


@pandas_udf(BinaryType())
def from_alaw(data: pd.Series) -> pd.Series:
    return data.map(lambda x: None if x is None else _from_alaw(np.frombuffer(x, np.uint8)).astype("<i2").tobytes())


def padded(pcm: Column, size: int) -> Column:
    """Bytes with silence behind them up to a whole number of ``size``."""
    missing = (size - F.octet_length(pcm) % size) % size
    return F.concat(pcm, F.substring(F.lit(bytes(size)), 1, 0) if size < 1 else F.substr(F.lit(bytes(size)), F.lit(1), missing))


def normaliser(peak: float = 0.9):
    """A UDF that brings the loudest sample to a share of full scale; silence stays."""
    return _each(lambda s: s * (peak * 32767 / np.abs(s).max()) if len(s) and np.abs(s).max() > 0 else s)


def band_filter(rate: int, low: float | None = None, high: float | None = None, taps: int = 101):
    """A UDF that keeps a band of frequencies: a windowed-sinc filter of linear phase. A telephone has 300 to 3400 Hz, a muffled voice no more than 1000."""
    k = np.arange(taps) - (taps - 1) / 2
    ideal = lambda f: 2 * f / rate * np.sinc(2 * f / rate * k)
    h = (ideal(high) if high is not None else np.where(k == 0, 1.0, 0.0)) - (ideal(low) if low is not None else 0.0)
    h = h * np.hamming(taps)
    return _each(lambda s: np.convolve(s, h, mode="same")[: len(s)] if len(s) >= taps else np.convolve(s, h)[(taps - 1) // 2 :][: len(s)])


def burst_noise(rate: int, starts: Sequence[float], seconds: float, snr_db: float, seed: int):
    """A UDF that lays bursts of noise that fade in and out over a track, at a ratio to the reference speech."""
    rng = np.random.default_rng(seed)
    n = max(1, int(rate * seconds))
    burst = rng.standard_normal(n) * np.hanning(n)
    burst *= SPEECH_RMS / max(float(np.sqrt((burst**2).mean())), LEAST_RMS) * 10 ** (-snr_db / 20)

    def lay(s: np.ndarray) -> np.ndarray:
        s = s.copy()
        for t in starts:
            a = int(rate * t)
            part = s[a : a + n]
            part += burst[: len(part)]
        return s

    return _each(lay)

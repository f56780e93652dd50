"""Numpy kernels on the samples of a batch of recordings."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: The rate of a record that names none.
RATE = 500


def fourier(x: np.ndarray, m: int) -> np.ndarray:
    """Rows of x at m samples by the Fourier method: spectra are cut or padded; the middle bin of an even length is
    doubled when shrinking and halved when growing."""
    n = x.shape[-1]
    if m == n or n == 0:
        return x
    if m == 0:
        return x[..., :0]
    spectrum = np.fft.rfft(x, axis=-1)
    few = min(n, m)
    out = np.zeros((*x.shape[:-1], m // 2 + 1), complex)
    out[..., : few // 2 + 1] = spectrum[..., : few // 2 + 1]
    if few % 2 == 0:
        out[..., few // 2] *= 2 if m < n else 0.5
    return np.fft.irfft(out, m, axis=-1) * (m / n)


def linear(x: np.ndarray, m: int) -> np.ndarray:
    """Rows of x at m samples by linear interpolation between half-pixel centres."""
    n = x.shape[-1]
    place = np.maximum(0, (np.arange(m) + 0.5) * n / m - 0.5)
    left = np.minimum(place.astype(int), n - 1)
    w = place - left
    return x[..., left] * (1 - w) + x[..., np.minimum(left + 1, n - 1)] * w


def stretches(begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The places begin, begin + 1, ... of each stretch of ``size`` places, end to end."""
    return np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size - begin, size)


@dataclass
class Signals:
    """The signals of a batch: all samples end to end, the leads of each record, the samples of each lead, and which are null."""

    x: np.ndarray
    many: np.ndarray
    size: np.ndarray
    no_signal: np.ndarray
    no_lead: np.ndarray

    @staticmethod
    def of(column: pa.Array) -> Signals:
        signals = column.cast(pa.list_(pa.list_(pa.float64())))
        leads = signals.flatten()
        return Signals(
            np.asarray(pc.fill_null(leads.flatten(), np.nan), np.float64),
            np.asarray(pc.fill_null(signals.value_lengths(), 0), np.int64),
            np.asarray(pc.fill_null(leads.value_lengths(), 0), np.int64),
            np.asarray(signals.is_null()),
            np.asarray(leads.is_null()),
        )

    def arrow(self) -> pa.Array:
        ends = lambda n: pa.array(np.append(0, np.cumsum(n)).astype(np.int32))
        inner = pa.ListArray.from_arrays(ends(self.size), pa.array(self.x), mask=pa.array(self.no_lead))
        return pa.ListArray.from_arrays(ends(self.many), inner, mask=pa.array(self.no_signal))

    @property
    def begin(self) -> np.ndarray:
        return np.cumsum(self.size) - self.size

    @property
    def lead(self) -> np.ndarray:
        """The number of each lead in its record."""
        return stretches(np.zeros(len(self.many), np.int64), self.many)

    def matrices(self) -> list[np.ndarray]:
        """Each record as a matrix, a view of the samples, where its leads have one length; else a list of its leads."""
        ends, begin = np.cumsum(self.many), self.begin
        out: list = []
        for a, b in zip((ends - self.many).tolist(), ends.tolist()):
            size = self.size[a:b]
            if len(size) and (size == size[0]).all():
                out.append(self.x[begin[a] : begin[a] + len(size) * size[0]].reshape(len(size), -1))
            else:
                out.append([self.x[i : i + n] for i, n in zip(begin[a:b].tolist(), size.tolist())])
        return out

    def by_length(self, change: Callable[[np.ndarray, float], np.ndarray], rate: np.ndarray | None = None) -> Signals:
        """``change(leads, rate)`` of the leads of one length and rate at once, as rows of a matrix."""
        rate = np.zeros(len(self.size)) if rate is None else np.repeat(rate, self.many)
        kinds, at = np.unique(np.stack([self.size, rate]), axis=1, return_inverse=True)
        begin, new, out = self.begin, self.size.copy(), []
        for k, (n, fs) in enumerate(kinds.T):
            if n:
                own = np.flatnonzero(at.ravel() == k)
                out.append((own, np.asarray(change(self.x[begin[own][:, None] + np.arange(int(n))], fs), float)))
                new[own] = out[-1][1].shape[1]
        begin, flat = np.cumsum(new) - new, np.zeros(int(new.sum()))
        for own, y in out:
            flat[(begin[own][:, None] + np.arange(y.shape[1])).ravel()] = y.ravel()
        return replace(self, x=flat, size=new)

    def fitted(self, length: int) -> Signals:
        """Leads of ``length`` samples: cut from the front, or zeros at the end."""
        size = np.where(self.no_lead, 0, length)
        kept = np.minimum(self.size, size)
        flat = np.zeros(int(size.sum()))
        flat[stretches(np.cumsum(size) - size, kept)] = self.x[stretches(self.begin, kept)]
        return replace(self, x=flat, size=size)

    def cut(self, offset: np.ndarray, chunk: int) -> Signals:
        """``chunk`` samples of each lead from its record's offset on, as far as there are any."""
        offset = np.repeat(offset, self.many)
        size = np.clip(self.size - offset, 0, chunk)
        return replace(self, x=self.x[stretches(self.begin + np.minimum(offset, self.size), size)], size=size)

    def take(self, rows: np.ndarray) -> Signals:
        """The records ``rows``, which may repeat."""
        leads = stretches((np.cumsum(self.many) - self.many)[rows], self.many[rows])
        size = self.size[leads]
        return Signals(self.x[stretches(self.begin[leads], size)], self.many[rows], size, self.no_signal[rows], self.no_lead[leads])

    def windows(self, chunk: int, n: int) -> tuple[Signals, np.ndarray]:
        """``n`` windows of ``chunk`` samples side by side for each record, and the record of each."""
        source = np.repeat(np.arange(len(self.many)), n)
        leads = stretches((np.cumsum(self.many) - self.many)[source], self.many[source])
        offset = np.repeat(np.tile(np.arange(n) * chunk, len(self.many)), self.many[source])
        size = np.clip(self.size[leads] - offset, 0, chunk)
        x = self.x[stretches(self.begin[leads] + np.minimum(offset, self.size[leads]), size)]
        return Signals(x, self.many[source], size, self.no_signal[source], self.no_lead[leads]), source

    def scaled(self, mean: list[float], std: list[float]) -> Signals:
        """(x - mean) / (std + 1e-8) with the numbers of the sample's lead; without such numbers it is not a number."""
        per = lambda v: np.repeat(np.append(np.asarray(v, float), np.nan)[np.minimum(self.lead, len(v))], self.size)
        return replace(self, x=(self.x - per(mean)) / (per(std) + 1e-8))

    def cleaned(self) -> Signals:
        return replace(self, x=np.where(np.isnan(self.x), 0.0, self.x))


def at_rate(signals: Signals, fs: pa.Array, target_fs: float) -> Signals:
    """Leads at ``target_fs``: round-half-even(n * target / fs) samples; those already at it stay as they are."""
    rate = np.asarray(pc.fill_null(fs.cast(pa.float64()), float(RATE)))
    return signals.by_length(lambda x, own: x if own == target_fs else fourier(x, round(x.shape[-1] * target_fs / own)), rate)

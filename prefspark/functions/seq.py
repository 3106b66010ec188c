"""Column expressions over ragged token arrays (``array<int>`` ids,
``array<double>`` log-probs / logits). Arrays hold real tokens only, so no
padding mask is needed: the mask is the array length."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from prefspark.functions.core import clamp


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def asum(arr) -> Column:
    """Left-to-right sum of a double array (0.0 when empty)."""
    return F.aggregate(_c(arr), F.lit(0.0), lambda a, x: a + x)


def completion(ids, ctx) -> Column:
    """Tokens after the first ``ctx`` context tokens."""
    ids, ctx = _c(ids), _c(ctx)
    return F.slice(ids, ctx + 1, F.greatest(F.size(ids) - ctx, F.lit(0)))


def truncate_at_stop(ids, eos: int) -> Column:
    """G1: keep up to and including the first EOS (all tokens when none)."""
    ids = _c(ids)
    pos = F.array_position(ids, eos)
    return F.when(pos > 0, F.slice(ids, F.lit(1), pos.cast("int"))).otherwise(ids)


def contains_eos(ids, ctx, eos: int) -> Column:
    """EOS among the completion tokens only."""
    return F.array_contains(completion(ids, ctx), eos)


def sequence_length(ids, pad: int) -> Column:
    """Index of the first PAD minus one (last index when there is no PAD)."""
    ids = _c(ids)
    pos = F.array_position(ids, pad).cast("int")
    return F.when(pos > 0, pos - 2).otherwise(F.size(ids) - 1)


def sequence_length_last_non_pad(ids, ctx, pad: int) -> Column:
    """G3, second form: context length + index of the last non-PAD completion
    token + 1 (just the context length when the completion is all PAD)."""
    comp = completion(ids, ctx)
    last = F.aggregate(F.sequence(F.lit(0), F.greatest(F.size(comp) - 1, F.lit(0))), F.lit(-1),
                       lambda acc, i: F.when((i < F.size(comp)) & (F.get(comp, i) != pad), i).otherwise(acc))
    return _c(ctx) + last + 1


def logsumexp(arr) -> Column:
    """Stable log(sum(exp(x))): max first, then the shifted sum."""
    arr = _c(arr)
    m = F.array_max(arr)
    return m + F.log(F.aggregate(arr, F.lit(0.0), lambda a, x: a + F.exp(x - m)))


def selected_log_softmax(logits, target, temperature: float = 1.0) -> Column:
    """logit[target]/T - logsumexp(logits/T)."""
    scaled = F.transform(_c(logits), lambda x: x / F.lit(float(temperature)))
    return F.get(scaled, _c(target)) - logsumexp(scaled)


def softmax_entropy(logits) -> Column:
    """logsumexp(l) - sum(softmax(l) * l)."""
    lg = _c(logits)
    lse = logsumexp(lg)
    return lse - F.aggregate(lg, F.lit(0.0), lambda a, x: a + F.exp(x - lse) * x)


def log_ratio(model, ref) -> Column:
    """logr per token = ref - model."""
    return F.zip_with(_c(ref), _c(model), lambda r, m: r - m)


def kl_tokens(model, ref, kind: str = "k3") -> Column:
    """G6 per token: k1 = -logr, k2 = logr^2 / 2, k3 = expm1(c) - c with
    c = clamp(logr, -40, 40) (the clamp only in k3). A NaN ratio stays NaN."""
    logr = log_ratio(model, ref)
    if kind == "k1":
        return F.transform(logr, lambda x: -x)
    if kind == "k2":
        return F.transform(logr, lambda x: F.lit(0.5) * x * x)
    if kind == "k3":
        return F.transform(logr, lambda x: F.expm1(clamp(x, -40, 40)) - clamp(x, -40, 40))
    raise ValueError(f"unknown KL estimator {kind!r}; known: k1, k2, k3")


def kl_estimate(model, ref, kind: str = "k3") -> Column:
    """The per-sequence KL estimate (sum over tokens)."""
    return asum(kl_tokens(model, ref, kind))

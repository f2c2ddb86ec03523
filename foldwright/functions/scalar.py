"""Scalar column functions that Spark has no single built-in for."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Wichura's algorithm AS 241 (PPND16), lowest power first.
_PPF_CENTRE = (
    (3.3871328727963666080e0, 1.3314166789178437745e2, 1.9715909503065514427e3,
     1.3731693765509461125e4, 4.5921953931549871457e4, 6.7265770927008700853e4,
     3.3430575583588128105e4, 2.5090809287301226727e3),
    (1.0, 4.2313330701600911252e1, 6.8718700749205790830e2, 5.3941960214247511077e3,
     2.1213794301586595867e4, 3.9307895800092710610e4, 2.8729085735721942674e4,
     5.2264952788528545610e3),
)
_PPF_MIDDLE = (
    (1.42343711074968357734e0, 4.63033784615654529590e0, 5.76949722146069140550e0,
     3.64784832476320460504e0, 1.27045825245236838258e0, 2.41780725177450611770e-1,
     2.27238449892691845833e-2, 7.74545014278341407640e-4),
    (1.0, 2.05319162663775882187e0, 1.67638483018380384940e0, 6.89767334985100004550e-1,
     1.48103976427480074590e-1, 1.51986665636164571966e-2, 5.47593808499534494600e-4,
     1.05075007164441684324e-9),
)
_PPF_TAIL = (
    (6.65790464350110377720e0, 5.46378491116411436990e0, 1.78482653991729133580e0,
     2.96560571828504891230e-1, 2.65321895265761230930e-2, 1.24266094738807843860e-3,
     2.71155556874348757815e-5, 2.01033439929228813265e-7),
    (1.0, 5.99832206555887937690e-1, 1.36929880922735805310e-1, 1.48753612908506148525e-2,
     7.86869131145613259100e-4, 1.84631831751005468180e-5, 1.42151175831644588870e-7,
     2.04426310338993978564e-15),
)
# Hart's rational form of the normal tail (as given by West, 2005), highest power first.
_TAIL_NUMERATOR = (3.52624965998911e-2, 0.700383064443688, 6.37396220353165, 33.912866078383,
                   112.079291497871, 221.213596169931, 220.206867912376)
_TAIL_DENOMINATOR = (8.83883476483184e-2, 1.75566716318264, 16.064177579207, 86.7807322029461,
                     296.564248779674, 637.333633378831, 793.826512519948, 440.413735824752)


def _horner(coefficients_high_first: Sequence[float], x: str) -> str:
    text = _num(coefficients_high_first[0])
    for c in coefficients_high_first[1:]:
        text = f"({text} * {x} + {_num(c)})"
    return text


def _num(value: float) -> str:
    # Exponent form keeps the literal a double in every SQL dialect.
    return f"{value:.17e}"


def _ratio(pair: tuple[Sequence[float], Sequence[float]], x: str) -> str:
    return f"({_horner(pair[0][::-1], x)} / {_horner(pair[1][::-1], x)})"


def normal_ppf_sql(p: str) -> str:
    """SQL text of the inverse normal CDF of expression ``p`` in (0, 1)."""
    q = f"({p} - 0.5e0)"
    centre = f"{q} * {_ratio(_PPF_CENTRE, f'(0.180625e0 - {q} * {q})')}"
    r = f"sqrt(-ln(least({p}, 1e0 - {p})))"
    tail = (
        f"(CASE WHEN {r} <= 5e0 THEN {_ratio(_PPF_MIDDLE, f'({r} - 1.6e0)')} "
        f"ELSE {_ratio(_PPF_TAIL, f'({r} - 5e0)')} END)"
    )
    return (
        f"(CASE WHEN abs({q}) <= 0.425e0 THEN {centre} "
        f"WHEN {q} < 0e0 THEN -{tail} ELSE {tail} END)"
    )


def normal_tail_sql(z: str) -> str:
    """SQL text of P(Z > |z|) for a standard normal Z."""
    a = f"abs({z})"
    body = f"exp(-{a} * {a} / 2e0) * {_horner(_TAIL_NUMERATOR, a)} / {_horner(_TAIL_DENOMINATOR, a)}"
    far = (
        f"exp(-{a} * {a} / 2e0) / ({a} + 1e0 / ({a} + 2e0 / ({a} + 3e0 / ({a} + 4e0 / "
        f"({a} + 0.65e0))))) / 2.506628274631e0"
    )
    return f"(CASE WHEN {a} > 37e0 THEN 0e0 WHEN {a} < 7.07106781186547e0 THEN {body} ELSE {far} END)"


def normal_ppf(column_name: str) -> Column:
    """Inverse normal CDF of a column holding probabilities in (0, 1)."""
    return F.expr(normal_ppf_sql(column_name))


def normal_tail(column_name: str) -> Column:
    """Upper tail probability of |column| under the standard normal."""
    return F.expr(normal_tail_sql(column_name))


def argmax(array: Column) -> Column:
    """0-based index of the first largest element."""
    return (F.array_position(array, F.array_max(array)) - 1).cast("int")


def fixed_digits(value: Column, digits: int = 4) -> Column:
    """Fixed-digit text, '-' for a missing value."""
    return F.when(value.isNull() | F.isnan(value), F.lit("-")).otherwise(
        F.format_string(f"%.{digits}f", value)
    )


def lookup(mapping: Column, key: str, default: str = "-") -> Column:
    """Map lookup with a default for absent keys."""
    return F.coalesce(F.try_element_at(mapping, F.lit(key)), F.lit(default))


def namespace(params: Column, prefix: str) -> Column:
    """Entries whose key starts with ``prefix.``, with the prefix removed."""
    dotted = f"{prefix}."
    kept = F.map_filter(params, lambda k, _: k.startswith(dotted))
    return F.transform_keys(kept, lambda k, _: F.substring(k, F.lit(len(dotted) + 1), F.length(k)))


def known_params(params: Column, allowed: Sequence[str]) -> Column:
    """Only the entries an estimator knows."""
    return F.map_filter(params, lambda k, _: k.isin(*allowed))


def truncated(value: Column, limit: int = 500) -> Column:
    return F.substring(value, 1, limit)


def null_if_nan(value: Column) -> Column:
    return F.when(~F.isnan(value), value)


def hash_unit(*parts: Column) -> Column:
    """A uniform draw in [0, 1) from the md5 of the ':'-joined parts (28 bits)."""
    digest = F.md5(F.concat_ws(":", *[p.cast("string") for p in parts]))
    return F.conv(F.substring(digest, 1, 7), 16, 10).cast("double") / F.lit(float(16**7))


def child_seed(base: int, index: Column) -> Column:
    """Deterministic child seed of a base seed."""
    digest = F.md5(F.concat(F.lit(f"{base}:"), index.cast("string")))
    return F.conv(F.substring(digest, 1, 7), 16, 10).cast("long")

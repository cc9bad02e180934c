"""Per-row loss terms as Catalyst expressions.

A loss is a function of the margin ``m = w.x`` and the label ``y``.  The gradient of the
mean loss is ``avg(slope * x_j)`` for every feature j, so every distributed computation in
the library is a plain aggregate of these expressions and stays inside whole-stage codegen.

What a loss offers (:class:`Loss` states it, and fills in what can be derived):

* ``term_sql(m, y)``, ``slope_sql(m, y)``: the term and its derivative in ``m`` as SQL text.
  At a kink the slope is any subgradient.
* ``curvature_sql(m, y)``: the second derivative; only Newton-step trials ask for it.
* ``change_sql(m, q, y)``: ``term(m + q) - term(m)`` without the cancellation of that
  difference, so that a line search can compare steps near the optimum.  Optional.
* ``of_batch(m, y)``, ``change_of_batch(m, q, y)``: the same over numpy arrays, for designs
  of arrays or sparse rows.  Optional: without them the margin and the loss are computed in
  the JVM for these designs too, and only the sums over features use arrays.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F


class Loss:
    """What the passes ask of a loss; ``term_sql`` and ``slope_sql`` have no default."""

    name: str
    #: (terms, slopes) of numpy arrays, or None.
    of_batch = None
    #: The objective is a quadratic along any direction.
    quadratic = False

    def term_sql(self, m: str, y: str) -> str:
        raise NotImplementedError

    def slope_sql(self, m: str, y: str) -> str:
        raise NotImplementedError

    def curvature_sql(self, m: str, y: str) -> str:
        raise ValueError(f"the loss {self.name!r} states no curvature")

    def change_sql(self, m: str, q: str, y: str) -> str:
        return f"({self.term_sql(f'({m} + {q})', y)} - {self.term_sql(m, y)})"

    def change_of_batch(self, m, q, y):
        return self.of_batch(m + q, y)[0] - self.of_batch(m, y)[0]

    def term(self, m: Column, y: Column) -> Column:
        raise NotImplementedError

    def slope(self, m: Column, y: Column) -> Column:
        raise NotImplementedError


@dataclass(frozen=True)
class SquaredLoss(Loss):
    """Least squares: loss ``(m - y)^2 / 2``, slope ``m - y``."""

    name: str = "squared"
    quadratic = True

    def term(self, m: Column, y: Column) -> Column:
        r = m - y
        return r * r * F.lit(0.5)

    def slope(self, m: Column, y: Column) -> Column:
        return m - y

    def term_sql(self, m: str, y: str) -> str:
        return f"(({m} - {y}) * ({m} - {y}) * 0.5D)"

    def slope_sql(self, m: str, y: str) -> str:
        return f"({m} - {y})"

    def curvature_sql(self, m: str, y: str) -> str:
        """Second derivative of the term in ``m``."""
        return "1.0D"

    def change_sql(self, m: str, q: str, y: str) -> str:
        return f"({q} * (({m} - {y}) + 0.5D * {q}))"

    def of_batch(self, m, y):
        """(terms, slopes) of numpy arrays."""
        return 0.5 * (m - y) ** 2, m - y

    def change_of_batch(self, m, q, y):
        return q * ((m - y) + 0.5 * q)


@dataclass(frozen=True)
class LogisticLoss(Loss):
    """Binary logistic loss for labels 0/1: ``log(1 + e^m) - y*m``, slope ``sigmoid(m) - y``.

    Written in the overflow-free form ``max(m, 0) + log1p(e^-|m|) - y*m``.  With
    ``s = 1 - 2y`` the term of a label 0 or 1 is ``log(1 + e^(s*m))``, so its change by ``q`` is
    ``log1p(sigmoid(s*m) * expm1(s*q))``, exact to the last digits however small ``q`` is; other
    labels mix the two.  Beyond ``|q| = 1`` the plain difference is as good.
    """

    name: str = "logistic"

    def term(self, m: Column, y: Column) -> Column:
        return F.greatest(m, F.lit(0.0)) + F.log1p(F.exp(-F.abs(m))) - y * m

    def slope(self, m: Column, y: Column) -> Column:
        return sigmoid(m) - y

    def term_sql(self, m: str, y: str) -> str:
        return f"(greatest({m}, 0.0D) + log1p(exp(-abs({m}))) - {y} * {m})"

    def slope_sql(self, m: str, y: str) -> str:
        return f"(1.0D / (1.0D + exp(-{m})) - {y})"

    def curvature_sql(self, m: str, y: str) -> str:
        """``sigmoid(m) * (1 - sigmoid(m))``."""
        return f"(1.0D / (1.0D + exp(-{m})) * (1.0D - 1.0D / (1.0D + exp(-{m}))))"

    def change_sql(self, m: str, q: str, y: str) -> str:
        one = "log1p(expm1({s} * {q}) / (1.0D + exp(-{s} * {m})))"
        plain = f"({self.term_sql(f'({m} + {q})', y)} - {self.term_sql(m, y)})"
        mixed = f"((1.0D - {y}) * {one.format(s='1.0D', q=q, m=m)} + {y} * {one.format(s='(-1.0D)', q=q, m=m)})"
        return f"CASE WHEN abs({q}) > 1.0D THEN {plain} WHEN {y} = 0.0D OR {y} = 1.0D THEN {one.format(s=f'(1.0D - 2.0D * {y})', q=q, m=m)} ELSE {mixed} END"

    def of_batch(self, m, y):
        """(terms, slopes) of numpy arrays."""
        import numpy as np

        e = np.exp(-np.abs(m))
        return np.maximum(m, 0) + np.log1p(e) - y * m, np.where(m >= 0, 1, e) / (1 + e) - y

    def slope_of_batch(self, m, y):
        """The slopes of :meth:`of_batch` alone."""
        import numpy as np

        e = np.exp(-np.abs(m))
        return np.where(m >= 0, 1, e) / (1 + e) - y

    def change_of_batch(self, m, q, y):
        import numpy as np

        near = np.clip(q, -1, 1)
        with np.errstate(over="ignore"):
            if ((y == 0) | (y == 1)).all():
                s = 1 - 2 * y
                out = np.log1p(np.expm1(s * near) / (1 + np.exp(-s * m)))
            else:
                up, down = np.log1p(np.expm1(near) / (1 + np.exp(-m))), np.log1p(np.expm1(-near) / (1 + np.exp(m)))
                # a label of 0 or 1 takes one of the two as it is
                out = np.where(y == 0, up, np.where(y == 1, down, (1 - y) * up + y * down))
        far = ~(np.abs(q) <= 1)
        if far.any():
            m, q, y = m[far], q[far], y[far]
            out[far] = self.of_batch(m + q, y)[0] - self.of_batch(m, y)[0]
        return out


@dataclass(frozen=True)
class SqlLoss(Loss):
    """A loss from SQL text in ``{z}`` (the margin) and ``{y}`` (the label), for any design and fit.

    ``SqlLoss("huber", "CASE WHEN abs({z} - {y}) <= 1 THEN ... END", slope="...")``.  ``slope`` is
    the derivative in ``{z}``, at a kink any subgradient (a line search needs a smooth loss,
    gradient descent does not).  :meth:`checked` compares it with differences of the term.
    """

    name: str
    expression: str
    slope_expression: str
    curvature_expression: str | None = None

    def _fill(self, text: str, z: str, y: str) -> str:
        return "(" + text.replace("{z}", f"({z})").replace("{y}", y) + ")"

    def term_sql(self, m: str, y: str) -> str:
        return self._fill(self.expression, m, y)

    def slope_sql(self, m: str, y: str) -> str:
        return self._fill(self.slope_expression, m, y)

    def curvature_sql(self, m: str, y: str) -> str:
        if self.curvature_expression is None:
            return super().curvature_sql(m, y)
        return self._fill(self.curvature_expression, m, y)

    def checked(self, spark: SparkSession, margins=None, labels=(0.0, 1.0, -0.7), kinks: int = 0) -> SqlLoss:
        """Self, if slope and curvature agree with differences at the given points.

        ``kinks``: at how many margins for one label the slope may lie anywhere between the one-sided differences.
        """
        zs = [float(v) for v in (margins if margins is not None else [k / 8 + 0.013 for k in range(-32, 33)])]
        h = 1e-5
        rows = spark.createDataFrame([(z, float(y)) for z in zs for y in labels], "z double, y double")
        step = {k: f"(z + {k * h!r}D)" for k in (-1, 1)}
        parts = {"up": self.term_sql(step[1], "y"), "down": self.term_sql(step[-1], "y"), "mid": self.term_sql("z", "y"), "slope": self.slope_sql("z", "y")}
        parts |= {"s_up": self.slope_sql(step[1], "y"), "s_down": self.slope_sql(step[-1], "y")}
        parts["curve"] = self.curvature_sql("z", "y") if self.curvature_expression is not None else "CAST(NULL AS DOUBLE)"
        bad: dict[float, list[float]] = {}
        for r in rows.selectExpr("z", "y", *[f"CAST({e} AS DOUBLE) AS {n}" for n, e in parts.items()]).collect():
            left, right = (r["mid"] - r["down"]) / h, (r["up"] - r["mid"]) / h
            room = 1e-3 * (1 + abs(r["slope"]))
            if not min(left, right) - room <= r["slope"] <= max(left, right) + room:
                raise ValueError(f"loss {self.name!r}: at z = {r['z']}, y = {r['y']} the slope is {r['slope']}, differences give {left} and {right}")
            curve = (r["s_up"] - r["s_down"]) / (2 * h)
            if abs(left - right) > room or (r["curve"] is not None and abs(curve - r["curve"]) > 1e-3 * (1 + abs(curve))):
                bad.setdefault(r["y"], []).append(r["z"])
        for y, where in bad.items():
            if len(where) > kinks:
                raise ValueError(f"loss {self.name!r}: not smooth, or its curvature is not that of its slope, at y = {y} and z in {where[:5]}")
        return self


def hinge_loss() -> SqlLoss:
    """``max(0, 1 - (2y - 1) z)`` for labels 0/1; 0 is taken as the slope at the kink."""
    margin = "(2.0D * {y} - 1.0D) * {z}"
    return SqlLoss("hinge", f"greatest(0.0D, 1.0D - {margin})", f"CASE WHEN {margin} < 1.0D THEN 1.0D - 2.0D * {{y}} ELSE 0.0D END")


def huber_loss(delta: float = 1.0) -> SqlLoss:
    """Squared up to an error of ``delta``, linear beyond."""
    d, r = f"{float(delta)!r}D", "({z} - {y})"
    return SqlLoss(
        "huber",
        f"CASE WHEN abs({r}) <= {d} THEN 0.5D * {r} * {r} ELSE {d} * (abs({r}) - 0.5D * {d}) END",
        f"greatest(-{d}, least({d}, {r}))",
        f"CASE WHEN abs({r}) <= {d} THEN 1.0D ELSE 0.0D END",
    )


def sigmoid(m: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-m))


LOSSES = {"squared": SquaredLoss(), "logistic": LogisticLoss(), "hinge": hinge_loss(), "huber": huber_loss()}


def takes_batches(loss) -> bool:
    """Whether a loss states its terms over numpy arrays."""
    return getattr(loss, "of_batch", None) is not None


def get_loss(loss) -> Loss:
    """A loss by name, or an object that offers what :class:`Loss` states."""
    if isinstance(loss, str):
        try:
            return LOSSES[loss]
        except KeyError:
            raise ValueError(f"unknown loss {loss!r}; expected one of {sorted(LOSSES)}") from None
    missing = [a for a in ("name", "term_sql", "slope_sql", "change_sql") if not hasattr(loss, a)]
    if missing:
        raise TypeError(f"a loss needs {', '.join(missing)} (see ridgeline.functions.losses.Loss)")
    return loss

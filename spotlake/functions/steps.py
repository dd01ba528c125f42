"""Steps that a user types: assignments to columns, exchanges of axes, spirals over time. A text becomes column expressions; nothing
in it is run as a program."""

from __future__ import annotations

import ast
import math
import operator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

OPERATIONS = {ast.Add: operator.add, ast.Sub: operator.sub, ast.Mult: operator.mul, ast.Div: operator.truediv, ast.Mod: operator.mod, ast.Pow: F.pow}
FUNCTIONS = {"sqrt": F.sqrt, "exp": F.exp, "log": F.log, "sin": F.sin, "cos": F.cos, "tan": F.tan, "abs": F.abs, "floor": F.floor, "ceil": F.ceil}


def _value(node: ast.AST, columns: list[str]) -> Column:
    match node:
        case ast.Constant(value=int() | float() as number) if not isinstance(number, bool):
            return F.lit(number)
        case ast.Name(id=name) if name in columns:
            return F.col(f"`{name}`")
        case ast.Name(id="pi"):
            return F.lit(math.pi)
        case ast.Name(id=name):
            raise ValueError(f"there is no column {name}")
        case ast.UnaryOp(op=ast.USub(), operand=inner):
            return -_value(inner, columns)
        case ast.UnaryOp(op=ast.UAdd(), operand=inner):
            return _value(inner, columns)
        case ast.BinOp(left=left, op=op, right=right) if type(op) in OPERATIONS:
            return OPERATIONS[type(op)](_value(left, columns), _value(right, columns))
        case ast.Call(func=ast.Name(id=name), args=[inner], keywords=[]) if name in FUNCTIONS:
            return FUNCTIONS[name](_value(inner, columns))
    raise ValueError(f"{ast.unparse(node)} is not understood")


def _assignment(text: str, columns: list[str]) -> tuple[str, Column]:
    try:
        (line,) = ast.parse(text).body
    except (SyntaxError, ValueError) as wrong:
        raise ValueError(f"{text!r} is no step") from wrong
    match line:
        case ast.Assign(targets=[ast.Name(id=name)], value=value):
            return name, _value(value, columns)
        case ast.AugAssign(target=ast.Name(id=name), op=op, value=value) if type(op) in OPERATIONS:
            return name, OPERATIONS[type(op)](_value(ast.Name(id=name), columns), _value(value, columns))
    raise ValueError(f"{text!r} is no step")


def _flip(locs: DataFrame, a: str, b: str, pixelsize: float | None, width: float | None, height: float | None) -> DataFrame:
    missing = [c for c in (a, b) if c not in locs.columns]
    if missing:
        raise ValueError(f"there is no column {missing[0]}")
    if "z" not in (a, b):
        return locs.withColumns({a: F.col(b), b: F.col(a)})
    flat = b if a == "z" else a
    across = width if flat == "x" else height
    if pixelsize is None or across is None:
        raise ValueError("to exchange z needs the pixel size and the size of the view")
    return locs.withColumns({flat: F.col("z") / pixelsize + across / 2, "z": F.col(flat) * pixelsize})


def apply_step(locs: DataFrame, text: str, pixelsize: float | None = None, width: float | None = None, height: float | None = None, frames: int | None = None) -> DataFrame:
    """locs after one step:

    * `x = y / 2 + sin(frame)`, `x += 10`, `y -= 3`, `z *= 0.79`, ...: a column from columns, numbers, pi, + - * / % ** and the
      functions of one argument in FUNCTIONS; a new name is a new column.
    * `flip x y` exchanges columns; with z, in nm, the other becomes z in pixels from the middle of the view.
    * `spiral R N` lays rows along a spiral of N turns that reaches the radius R with the movie's last frame. It keeps the places
      before in _x and _y, which `uspiral` takes back; a second spiral starts from where the first left the rows.

    Other texts and unknown names are a ValueError. Nulls stay null.
    """
    match text.split():
        case ["flip", a, b]:
            return _flip(locs, a, b, pixelsize, width, height)
        case ["spiral", radius, turns]:
            if frames is None:
                raise ValueError("a spiral needs the number of frames")
            whole = int(turns) * 2 * math.pi
            angle = F.col("frame") * (whole / frames)
            out = {"_x": F.col("x"), "_y": F.col("y")}
            return locs.withColumns(out | {"x": F.col("x") + angle * F.cos(angle) / whole * float(radius), "y": F.col("y") + angle * F.sin(angle) / whole * float(radius)})
        case ["uspiral"]:
            if "_x" not in locs.columns or "_y" not in locs.columns:
                raise ValueError("there is no spiral to undo")
            return locs.withColumns({"x": F.col("_x"), "y": F.col("_y")}).drop("_x", "_y")
    name, value = _assignment(text, locs.columns)
    return locs.withColumn(name, value)

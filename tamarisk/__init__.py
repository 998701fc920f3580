"""tamarisk: e-mail risk analytics as Spark DataFrame transforms."""

from tamarisk.params import Dictionaries, RiskParams

__all__ = ["Dictionaries", "RiskParams"]

"""mailgrain: message-abuse analytics as Spark DataFrame transformations."""

from mailgrain.params import Params

__all__ = ["Params"]
__version__ = "0.1.0"

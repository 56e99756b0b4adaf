"""Operators on frames of encoded chunks."""

from .frame import NdFrame
from .regrid import OverlapError, Regridded, TableSink, regrid

__all__ = ["NdFrame", "OverlapError", "Regridded", "TableSink", "regrid"]

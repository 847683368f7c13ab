"""What all miners have in common."""

from __future__ import annotations

from abc import ABC, abstractmethod

from lodetrace.operators.log import EventLog


class Miner(ABC):
    """Finds a model of a log."""

    @abstractmethod
    def discover(self, log: EventLog):
        """The model of the log: an accepting net or a dependency graph."""

"""The games that the engine knows, by name."""

from __future__ import annotations

import re

from plyset.games.amazons import Amazons
from plyset.games.breakthrough import Breakthrough
from plyset.games.chess import Chess
from plyset.games.nim import NormalNim
from plyset.games.othello import Othello
from plyset.games.tictactoe import TicTacToe
from plyset.plans.game import Game

_PATTERNS = [
    (re.compile(r"amazons_(\d+)x(\d+)"), lambda w, h: Amazons(w, h)),
    (re.compile(r"breakthrough_(\d+)x(\d+)"), lambda w, h: Breakthrough(w, h)),
    (re.compile(r"breakthroughcw_(\d+)x(\d+)"), lambda w, h: Breakthrough(w, h, column_wise=True)),
    (re.compile(r"chess"), lambda: Chess()),
    (re.compile(r"normalnim_(\d+)x(\d+)"), lambda h, m: NormalNim(h, m)),
    (re.compile(r"othello_(\d+)x(\d+)"), lambda w, h: Othello(w, h)),
    (re.compile(r"tictactoe_(\d+)"), lambda n: TicTacToe(n)),
]


def get_game(name: str) -> Game:
    """``tictactoe_3``, ``normalnim_3x4``, ``breakthrough_5x6`` (``breakthroughcw``: column by column), ``amazons_4x4``, ``othello_4x4``, ``chess``."""
    for pattern, make in _PATTERNS:
        if m := pattern.fullmatch(name):
            return make(*map(int, m.groups()))
    raise ValueError(f"unknown game {name!r}")

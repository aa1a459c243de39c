"""Chess positions and moves: FEN, UCI text, legal moves, attacks, ends of games.

A board is 64 letters (a8 first, h1 last; ``.`` is empty), the side to move, castling rights, the
en-passant square and both clocks. This is a row-at-a-time generator by design: Spark runs it in
batches (``plyset.games.chess``), and tests use it as the oracle of the set-based predicates.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import lru_cache

START = "rnbqkbnr/pppppppp/8/8/8/8/PPPPPPPP/RNBQKBNR w KQkq - 0 1"

#: Piece letters by character (empty first), and castling rights by bit.
PIECES, RIGHTS = "." + "".join(white + white.lower() for white in "PNBRQK"), "KQkq"

_KNIGHT = ((1, 2), (2, 1), (-1, 2), (-2, 1), (1, -2), (2, -1), (-1, -2), (-2, -1))
_ROOK = ((1, 0), (-1, 0), (0, 1), (0, -1))
_BISHOP = ((1, 1), (1, -1), (-1, 1), (-1, -1))


def square(text: str) -> int:
    if len(text) != 2 or not ("a" <= text[0] <= "h" and "1" <= text[1] <= "8"):
        raise ValueError(f"no square: {text!r}")
    return (8 - int(text[1])) * 8 + ord(text[0]) - 97


def square_name(i: int) -> str:
    return "abcdefgh"[i % 8] + str(8 - i // 8)


@lru_cache(maxsize=None)
def rays(i: int, steps: tuple, far: bool) -> tuple[tuple[int, ...], ...]:
    """Squares from ``i`` on in each direction."""
    out = []
    for dx, dy in steps:
        x, y, way = i % 8 + dx, i // 8 + dy, []
        while 0 <= x < 8 and 0 <= y < 8:
            way.append(y * 8 + x)
            if not far:
                break
            x, y = x + dx, y + dy
        if way:
            out.append(tuple(way))
    return tuple(out)


def piece_rays(piece: str, i: int) -> tuple[tuple[int, ...], ...]:
    kind = piece.lower()
    if kind == "n":
        return rays(i, _KNIGHT, False)
    steps = {"b": _BISHOP, "r": _ROOK}.get(kind, _ROOK + _BISHOP)
    return rays(i, steps, kind != "k")


def between(a: int, b: int) -> tuple[int, ...] | None:
    """Squares strictly between two on one line, from ``a`` on; nothing if they aren't on one."""
    for way in rays(a, _ROOK + _BISHOP, True):
        if b in way:
            return way[: way.index(b)]
    return None


def move_table() -> list[tuple[str, int, int, tuple[int, ...]]]:
    """(piece, from, to, between) on an empty board; pawns move and capture apart (``P`` up, ``p`` down)."""
    out = [(k, i, to, way[:n]) for k in "kqrbn" for i in range(64) for way in piece_rays(k, i) for n, to in enumerate(way)]
    for piece, dy in (("P", -1), ("p", 1)):
        for i in range(8, 56):
            out.append((piece, i, i + 8 * dy, ()))
            if i // 8 == (6 if dy < 0 else 1):
                out.append((piece, i, i + 16 * dy, (i + 8 * dy,)))
            out += [(piece, i, i + 8 * dy + dx, ()) for dx in (-1, 1) if 0 <= i % 8 + dx < 8]
    return out


@dataclass(frozen=True)
class Board:
    cells: str
    white: bool = True
    castling: str = ""
    en_passant: int = -1
    halfmove: int = 0
    fullmove: int = 1

    @staticmethod
    def parse(fen: str) -> Board:
        """All six fields of a FEN; the clocks may be left out, and so may what follows the side."""
        fields = fen.split()
        if not 2 <= len(fields) <= 6:
            raise ValueError(f"no FEN: {fen!r}")
        cells = "".join("." * int(c) if c.isdigit() else c for c in fields[0].replace("/", ""))
        rows = fields[0].split("/")
        if len(rows) != 8 or len(cells) != 64 or set(cells) - set(".pnbrqkPNBRQK") or any(sum(int(c) if c.isdigit() else 1 for c in r) != 8 for r in rows):
            raise ValueError(f"no board: {fields[0]!r}")
        if fields[1] not in "wb" or len(fields[1]) != 1:
            raise ValueError(f"no side: {fields[1]!r}")
        castling = fields[2] if len(fields) > 2 and fields[2] != "-" else ""
        if set(castling) - set("KQkq"):
            raise ValueError(f"no castling rights: {castling!r}")
        # rights without king and rook at home are none
        home = {"K": (60, 63, "KR"), "Q": (60, 56, "KR"), "k": (4, 7, "kr"), "q": (4, 0, "kr")}
        castling = "".join(c for c in "KQkq" if c in castling and cells[home[c][0]] == home[c][2][0] and cells[home[c][1]] == home[c][2][1])
        ep = square(fields[3]) if len(fields) > 3 and fields[3] != "-" else -1
        clocks = [int(x) for x in fields[4:]] + [0, 1][len(fields[4:]) :]
        return Board(cells, fields[1] == "w", castling, ep, *clocks)

    def fen(self) -> str:
        rows = []
        for y in range(8):
            row, empty = "", 0
            for c in self.cells[8 * y : 8 * y + 8]:
                if c == ".":
                    empty += 1
                    continue
                row, empty = row + (str(empty) if empty else "") + c, 0
            rows.append(row + (str(empty) if empty else ""))
        ep = square_name(self.en_passant) if self.en_passant >= 0 else "-"
        return f"{'/'.join(rows)} {'w' if self.white else 'b'} {self.castling or '-'} {ep} {self.halfmove} {self.fullmove}"

    def key(self) -> str:
        """What tells positions apart: pieces, side, castling and en passant, without clocks."""
        return " ".join(self.fen().split()[:4])

    # -- attacks ------------------------------------------------------------------------------

    def attacked(self, target: int, by_white: bool) -> bool:
        cells = self.cells
        own = (lambda c: c.upper()) if by_white else (lambda c: c.lower())
        for way in rays(target, _KNIGHT, False):
            if cells[way[0]] == own("n"):
                return True
        for steps, kinds in ((_ROOK, own("r") + own("q")), (_BISHOP, own("b") + own("q"))):
            for way in rays(target, steps, True):
                for n, i in enumerate(way):
                    if cells[i] != ".":
                        if cells[i] in kinds or n == 0 and cells[i] == own("k"):
                            return True
                        break
        dy = 1 if by_white else -1
        y = target // 8 + dy
        return 0 <= y < 8 and any(0 <= target % 8 + dx < 8 and cells[y * 8 + target % 8 + dx] == own("p") for dx in (-1, 1))

    def check(self, white: bool | None = None) -> bool:
        """Whether the side's (by default the mover's) king is attacked; never without a king."""
        white = self.white if white is None else white
        king = self.cells.find("K" if white else "k")
        return king >= 0 and self.attacked(king, not white)

    # -- moves --------------------------------------------------------------------------------

    def _moved(self, a: int, b: int, promote: str = "") -> Board:
        cells = list(self.cells)
        piece, taken = cells[a], cells[b]
        cells[a], cells[b] = ".", promote or piece
        ep = -1
        if piece in "Pp":
            if b == self.en_passant and taken == "." and a % 8 != b % 8:
                cells[a // 8 * 8 + b % 8] = "."
            if abs(a - b) == 16:
                ep = (a + b) // 2
        if piece in "Kk" and abs(a - b) == 2:
            rook, to = (b + 1, b - 1) if b > a else (b - 2, b + 1)
            cells[rook], cells[to] = ".", cells[rook]
        lost = {60: "KQ", 63: "K", 56: "Q", 4: "kq", 7: "k", 0: "q"}
        castling = "".join(c for c in self.castling if c not in lost.get(a, "") + lost.get(b, ""))
        quiet = piece not in "Pp" and taken == "."
        return Board("".join(cells), not self.white, castling, ep, self.halfmove + 1 if quiet else 0, self.fullmove + (not self.white))

    def _candidates(self):
        cells, white = self.cells, self.white
        for a, piece in enumerate(cells):
            if piece == "." or piece.isupper() != white:
                continue
            if piece in "Pp":
                dy = -1 if white else 1
                targets = []
                if 0 <= a // 8 + dy < 8:
                    ahead = a + 8 * dy
                    if cells[ahead] == ".":
                        targets.append(ahead)
                        if a // 8 == (6 if white else 1) and cells[ahead + 8 * dy] == ".":
                            targets.append(ahead + 8 * dy)
                    for dx in (-1, 1):
                        if 0 <= a % 8 + dx < 8:
                            b = ahead + dx
                            if cells[b] != "." and cells[b].isupper() != white or b == self.en_passant and cells[b] == "." and b // 8 == (2 if white else 5):
                                targets.append(b)
                for b in targets:
                    if b // 8 in (0, 7):
                        yield from ((a, b, k if not white else k.upper()) for k in "qbnr")
                    else:
                        yield a, b, ""
                continue
            for way in piece_rays(piece, a):
                for b in way:
                    if cells[b] == "." or cells[b].isupper() != white:
                        yield a, b, ""
                    if cells[b] != ".":
                        break
        row = 56 if white else 0
        for right, free, crossed, to in (("K", (5, 6), (4, 5, 6), 6), ("Q", (1, 2, 3), (4, 3, 2), 2)):
            if (right if white else right.lower()) in self.castling and all(cells[row + i] == "." for i in free):
                if not any(self.attacked(row + i, not white) for i in crossed):
                    yield row + 4, row + to, ""

    def moves(self) -> list[tuple[str, Board]]:
        """Legal moves: UCI text and the board after it. Kings can't be taken."""
        out = []
        for a, b, promote in self._candidates():
            if self.cells[b] in "Kk":
                continue
            after = self._moved(a, b, promote)
            if not after.check(self.white):
                out.append((square_name(a) + square_name(b) + promote.lower(), after))
        return out

    def reaches(self, other: Board) -> bool:
        """Whether a legal move leads to the other board, clocks aside."""
        for a, b, promote in self._candidates():
            if self.cells[b] not in "Kk":
                after = self._moved(a, b, promote)
                if after.cells == other.cells and after.slots() == other.slots() and not after.check(self.white):
                    return True
        return False

    def unmoves(self) -> list[Board]:
        """All boards with a legal move to this one, clocks aside: pieces taken back, with every piece they may have
        captured, every right they may have had and every pawn that could have been taken en passant."""
        out: dict[tuple, Board] = {}
        white = not self.white
        for cells in self._before(white):
            homes = [r for r, k, i in (("K", 60, 63), ("Q", 60, 56), ("k", 4, 7), ("q", 4, 0)) if cells[k] == "kK"[r.isupper()] and cells[i] == "rR"[r.isupper()]]
            if set(self.castling) - set(homes):
                continue
            more = [r for r in homes if r not in self.castling]
            row, up, pawn = (16, -8, "p") if white else (40, 8, "P")
            passed = [i for i in range(row, row + 8) if cells[i] == cells[i + up] == "." and cells[i - up] == pawn]
            for k in range(1 << len(more)):
                rights = set(self.castling).union(r for n, r in enumerate(more) if k >> n & 1)
                for ep in (-1, *passed):
                    b = Board(cells, white, "".join(r for r in RIGHTS if r in rights), ep)
                    if b.reaches(self):
                        out[b.slots()] = b
        return list(out.values())

    def _before(self, white: bool):
        """Cells of boards that one piece of the side could have moved from; rules are left to the check afterwards."""
        cells, own = self.cells, str.upper if white else str.lower
        dy, last, mine = (-8, 0, "PNBRQK") if white else (8, 7, "pnbrqk")
        takes = mine.swapcase()[:-1]

        def moved(b, a, piece, taken="."):
            c = list(cells)
            c[a], c[b] = piece, taken
            return "".join(c)

        for b, piece in enumerate(cells):
            if piece not in mine:
                continue
            pawns = piece == own("p") or b // 8 == last and piece != own("k")  # a pawn, or what one has become
            if pawns and 0 <= b - dy < 64:
                if cells[b - dy] == ".":
                    yield moved(b, b - dy, own("p"))
                    if piece == own("p") and 0 <= b - 2 * dy < 64 and cells[b - 2 * dy] == ".":
                        yield moved(b, b - 2 * dy, piece)
                for a in (b - dy + dx for dx in (-1, 1) if 0 <= b % 8 + dx < 8):
                    if cells[a] == ".":
                        yield from (moved(b, a, own("p"), x) for x in takes if x not in "Pp" or b // 8 not in (0, 7))
                        if piece == own("p") and cells[b - dy] == ".":
                            yield moved(b, a, piece)[: b - dy] + own("p").swapcase() + moved(b, a, piece)[b - dy + 1 :]
            if piece == own("p"):
                continue
            for way in piece_rays(piece, b):
                for a in way:
                    if cells[a] != ".":
                        break
                    yield moved(b, a, piece)
                    yield from (moved(b, a, piece, x) for x in takes if x not in "Pp" or b // 8 not in (0, 7))
        row = 56 if white else 0
        for king, rook, corner in ((6, 5, 7), (2, 3, 0)):
            if cells[row + king] == own("k") and cells[row + rook] == own("r") and cells[row + 4] == cells[row + corner] == ".":
                c = list(cells)
                c[row + king] = c[row + rook] = "."
                c[row + 4], c[row + corner] = own("k"), own("r")
                yield "".join(c)

    def play(self, uci: str) -> Board:
        for text, after in self.moves():
            if text == uci:
                return after
        raise ValueError(f"{uci} isn't legal here")

    # -- ends ---------------------------------------------------------------------------------

    def checkmate(self) -> bool:
        return self.check() and not self.moves()

    def stalemate(self) -> bool:
        return not self.check() and not self.moves()

    def draw_by_rule(self) -> bool:
        return self.halfmove >= 100

    def draw_by_material(self) -> bool:
        """Kings alone, or with one bishop or knight."""
        rest = sorted(c.lower() for c in self.cells if c not in ".Kk")
        return rest in ([], ["b"], ["n"])

    def final(self) -> bool:
        return self.draw_by_rule() or self.draw_by_material() or not self.moves()

    def __str__(self) -> str:
        return "\n".join(" ".join(self.cells[8 * y : 8 * y + 8]) for y in range(8)) + f"\n{self.fen()}"

    # -- positions as slots -------------------------------------------------------------------

    def slots(self) -> tuple[int, ...]:
        """64 squares by piece letter (``PIECES``), then castling rights as four bits (``RIGHTS``), then the file of the
        pawn that may be taken en passant, counted from 1 (0: none). The side to move is no part of it."""
        rights = sum(1 << k for k, r in enumerate(RIGHTS) if r in self.castling)
        return (*(PIECES.index(c) for c in self.cells), rights, self.en_passant % 8 + 1 if self.en_passant >= 0 else 0)

    @staticmethod
    def from_slots(slots, white: bool) -> Board:
        *squares, rights, file = slots
        castling = "".join(r for k, r in enumerate(RIGHTS) if rights >> k & 1)
        ep = -1 if not file else (16 if white else 40) + file - 1
        return Board("".join(PIECES[c] for c in squares), white, castling, ep)

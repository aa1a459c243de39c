"""Command line: ``python -m plyset.cli COMMAND ...``.

forward GAME [PLIES]       positions after each ply, until none are left
backward GAME PLIES        winning, losing and unknown positions by ply, over the whole universe
solve GAME PLIES           within how few plies the first player wins or loses from the start
combined GAME PLIES        forward, then back: wins, losses and undecided positions by ply
stats GAME PLIES           the combined table as tab-separated text, with shares
print GAME PLY [K]         the first K positions after PLY plies
graph GAME                 nodes of the move graphs before and after pruning, and their rules
validate GAME PLY [K]      moves from the first K positions against the game's own generator
validate-backward GAME PLIES  the one-step rules over the winning and losing positions of the whole universe
validate-terminal GAME     that no position is both won and lost at the start, and that none of them may be moved from
moves FEN                  legal chess moves
perft FEN DEPTH            chess move paths by depth
divide FEN DEPTH           chess move paths by first move
"""

from __future__ import annotations

import sys

from pyspark.sql import SparkSession

from plyset.functions.chess import Board
from plyset.games import chess, get_game
from plyset.operators import checks
from plyset.plans.game import solve_forward_backward, with_fractions


def main(args: list[str]) -> int:
    if len(args) < 2:
        print(__doc__)
        return 2
    command, what, *rest = args
    number = [int(x) for x in rest]
    if command == "moves":
        print("\n".join(text for text, _ in Board.parse(what).moves()))
        return 0
    spark = SparkSession.builder.appName("plyset").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    if command in ("perft", "divide"):
        getattr(chess, command)(spark, what, number[0]).show(500, truncate=False)
        return 0
    game = get_game(what)
    if command == "forward":
        for ply, s in enumerate(game.frontiers(spark, number[0] if number else 100)):
            print(f"{ply}\t{s.size()}")
    elif command == "backward":
        game.solver(spark).table(number[0]).show(1000)
    elif command == "solve":
        found = game.solver(spark).outcome(number[0])
        print("unknown" if found is None else f"{'win' if found[1] > 0 else 'loss'} within {found[0]}")
        return int(found is None)
    elif command == "combined":
        solve_forward_backward(game, spark, number[0]).show(1000)
    elif command == "stats":
        df = with_fractions(solve_forward_backward(game, spark, number[0]))
        print("\t".join(df.columns))
        for r in df.orderBy("ply").toLocalIterator():
            print("\t".join(map(str, r)))
    elif command == "print":
        for r in game.positions_forward(spark, number[0]).first(number[1] if len(number) > 1 else 20).toLocalIterator():
            print(game.show(tuple(r)), end="\n\n")
    elif command == "graph":
        for side in (0, 1):
            g = game.move_graph(side)
            print(f"side {side}: {len(g)} nodes, {len(g.optimized())} after pruning, {len(game.rules(side))} rules")
    elif command == "validate":
        fine = checks.moves(game, number[0] % 2, game.positions_forward(spark, number[0]), number[1] if len(number) > 1 else 1000)
        print("agree" if fine else "DIFFER")
        return int(not fine)
    elif command == "validate-backward":
        fine = checks.solved(game, game.solver(spark), number[0])
        print("agree" if fine else "DIFFER")
        return int(not fine)
    elif command == "validate-terminal":
        fine = all(checks.terminal(game, spark, side) for side in (0, 1))
        print("agree" if fine else "DIFFER")
        return int(not fine)
    else:
        print(__doc__)
        return 2
    return 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))

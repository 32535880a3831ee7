"""rankloom: pairwise ranking, rater reliability and data-quality operators on Spark DataFrames."""

from .errors import InsufficientRatingsError, MissingColumnError, RankloomError, ScoreShapeError, TooLargeError, UnknownDistanceError, UnknownItemError
from .operators.log import ARENA_WINNERS, DRAW, LEFT, RIGHT, WINNERS, Log, edges, encode, item_index, prepare, strict_violations, unknown_items, without_ties
from .operators.matrices import combined, pairwise_scores, pivot_scores, win_fractions, win_tie_grid
from .operators.ranking import METHODS, average_win_rate, bradley_terry, counting, eigen, elo, newman, pagerank
from .operators.reliability import DISTANCES, alpha, ratings
from .operators.report import leaderboard, pair_counts, with_rank
from .operators.resampling import alpha_bootstrap, alpha_distribution, bootstrap, distribution

__version__ = "0.1.0"

__all__ = [
    "ARENA_WINNERS", "DISTANCES", "DRAW", "InsufficientRatingsError", "LEFT", "Log", "METHODS", "MissingColumnError", "RIGHT", "RankloomError", "ScoreShapeError", "TooLargeError",
    "UnknownDistanceError", "UnknownItemError", "WINNERS", "__version__", "alpha", "alpha_bootstrap", "alpha_distribution", "average_win_rate", "bootstrap", "bradley_terry", "combined",
    "counting", "distribution", "edges", "eigen", "elo", "encode", "item_index", "leaderboard", "newman", "pagerank", "pair_counts", "pairwise_scores", "pivot_scores", "prepare",
    "ratings", "strict_violations", "unknown_items", "win_fractions", "win_tie_grid", "with_rank", "without_ties",
]

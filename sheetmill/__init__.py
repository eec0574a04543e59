"""Part of the answer-sheet analytics engine."""

"""Nothing streams here: the engine compares two finished versions, so every operator is a batch.

The one hand-over between its parts, names already reported by the structural
diff, is the anti join ``driftlens.operators.matching.unmatched``.
"""

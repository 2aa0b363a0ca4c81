"""txnlake: a Spark-native payments-fraud lakehouse.

Raw payment transactions -> cleaned (silver) table -> staging / fact / user
dimension -> risk marts -> leak-free windowed features -> weighted fraud
classifiers.  Every step is a DataFrame transformation planned by Catalyst.
"""

__version__ = "0.1.0"

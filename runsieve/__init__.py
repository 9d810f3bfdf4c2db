"""Evaluation of question-answering and tool-calling agents as Spark jobs.

Everything works on DataFrames keyed by ``(eval_run_id, case_id)``: many runs
are scored, aggregated and gated in one plan.
"""

__version__ = "0.1.0"

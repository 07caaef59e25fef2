"""Evaluation of model output on multiple-choice questions, as Spark DataFrame operators."""

"""Spark analytics for labelled corpora, scored predictions and field detections."""

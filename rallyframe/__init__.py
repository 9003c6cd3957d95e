"""Spark-native analytics over racket-sport tracking tables."""

"""Spark-native molecular disassembly analytics."""

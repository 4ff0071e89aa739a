"""Part of the disassembly engine."""

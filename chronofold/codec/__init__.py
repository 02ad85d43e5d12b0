"""The compact binary interchange format: columns, chunks, cursors, peer messages.  Plain Python, used at the edges only."""

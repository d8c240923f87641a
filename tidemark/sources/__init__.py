"""Delimited text in and out (LOAD DATA INFILE, SELECT ... INTO OUTFILE)."""

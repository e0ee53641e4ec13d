"""Folders of the given tables that the tests read."""

SF = "/root/testdata/sf0.001"
SF01 = "/root/testdata/sf0.01"

"""Folders of the test tables, under a module name that no conftest shares."""

SF001 = "/root/testdata/sf0.001"
SF01 = "/root/testdata/sf0.01"

"""Column functions: everything here maps Column to Column and stays inside Catalyst unless it says so."""

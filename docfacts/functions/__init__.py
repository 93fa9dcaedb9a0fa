"""docfacts.functions"""

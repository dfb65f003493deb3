"""Stateful operators over keyed page streams."""

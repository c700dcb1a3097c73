"""Text and JSON shapes as tables: lines with their places, parsed by column expressions; a bad line is a row with an error."""
